"""Reads that arrive as a stream, mapped batch by batch against a fixed set of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.jobs.mapping import map_best, stored_index
from strandloom.jobs.options import Options


def map_stream(
    reads: DataFrame, references: DataFrame, r_key: str, output: str, checkpoint: str, q_key: str = "read_id", options: Options = Options()  # noqa: B008
) -> StreamingQuery:
    """Write the best hits of every micro-batch as Parquet, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each read is written once.  The references
    are sketched once, before the first batch.
    """
    stored = stored_index(references, r_key, options)

    def write(batch: DataFrame, number: int) -> None:
        map_best(batch, q_key, references, r_key, options, stored).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(spark: SparkSession, mapped: str) -> DataFrame:
    """(batch, reads, hits) of what ``map_stream`` has written."""
    return spark.read.parquet(mapped).groupBy("batch").agg(F.countDistinct("read_id").alias("reads"), F.count("*").alias("hits"))
