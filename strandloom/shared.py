"""Intermediate tables in the folder that spark.checkpoint.dir names, which all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where there is none and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Tables written once and read back, so that a lost executor costs no more than the last table."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{shared_folder(spark)}/strandloom-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self._root}/{name}"

    def stash(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
        return self._spark.read.schema(df.schema).options(**(options or {})).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
