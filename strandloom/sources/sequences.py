"""FASTA, FASTQ and BED readers on Spark's text source, which splits files and reads gzip."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READS = "name string, comment string, seq string, qual string, len int"


def _header(line) -> tuple:
    name = F.regexp_extract(line, r"^(\S*)", 1)
    return name.alias("name"), F.nullif(F.trim(F.regexp_extract(line, r"^\S*\s+(.*)$", 1)), F.lit("")).alias("comment")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files: sequences over several lines are joined, U becomes T, empty records stay."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length("value") > 0)
    whole = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head, body = F.regexp_extract(whole, r"^([^\n]*)", 1), F.regexp_extract(whole, r"(?s)^[^\n]*\n(.*)$", 1)
    seq = F.translate(F.regexp_replace(body, r"\s", ""), "Uu", "Tt")
    return rows.select(*_header(head), seq.alias("seq"), F.lit(None).cast("string").alias("qual"), F.length(seq).alias("len"))


_PIECE = "file string, block long, half int, record string"


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (half 0) of pieces cut at every line that begins with @.

    A piece of three lines lacks its quality, which began with @ and is the next piece.  Where a split ends
    between the two they leave as halves: 1 without quality, 2 the quality.
    """
    held, place = None, None
    for batch in batches:
        out: list[tuple] = []
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != place:
                if held is not None:
                    out.append((*place, 1, held))
                held, place = None, (file, block)
            value = value.replace("\r", "")
            if held is not None:
                value, held = f"{held}\n@{value}", None
            lines = value.rstrip("\n").count("\n") + 1
            if not value.strip():
                continue
            if lines == 3:
                held = value.rstrip("\n")
            else:
                out.append((file, block, 0 if lines >= 4 else 2, value))
        yield _pieces(out)
    if held is not None:
        yield _pieces([(*place, 1, held)])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "half", "record"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTQ files of four lines each; a record whose quality has another length has a null seq.

    Files are split.  A quality line that begins with @ starts no record, even where a split ends before it:
    the two halves of such a record, at most one a split, are put together by their places in the file.
    """
    pieces = spark.read.option("lineSep", "\n@").text(path)
    joined = pieces.select("_metadata.file_path", "_metadata.file_block_start", "value").mapInArrow(_join_pieces, _PIECE)
    order = Window.partitionBy("file").orderBy("block", F.desc("half"))
    halves = joined.where("half > 0").withColumn("before", F.when(F.lag("half").over(order) == 1, F.lag("record").over(order)))
    mended = halves.where("half = 2 AND before IS NOT NULL").select(F.concat_ws("\n@", "before", "record").alias("record"))
    lines = joined.where("half = 0").select("record").unionByName(mended).select(F.split("record", "\n").alias("l"))
    seq, qual = F.translate(F.get("l", 1), "Uu", "Tt"), F.get("l", 3)
    fits = F.length(seq) == F.length(qual)
    return lines.select(
        *_header(F.regexp_replace(F.get("l", 0), "^@", "")), F.when(fits, seq).alias("seq"), F.when(fits, qual).alias("qual"), F.length(seq).alias("len")
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED12 rows with the columns that ``bed_blocks`` reads; headers and short lines are left out."""
    parts = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", r"\t").alias("p"))
    at = lambda k: F.get("p", k)
    return parts.where(F.size("p") >= 3).select(
        F.coalesce(at(3), F.concat_ws(":", at(0), at(1), at(2))).alias("name"),
        at(0).alias("chrom"),
        at(1).cast("int").alias("st"),
        at(2).cast("int").alias("en"),
        F.coalesce(at(5), F.lit(".")).alias("strand"),
        at(10).alias("block_sizes"),
        at(11).alias("block_starts"),
    )


def fragment_name(name) -> object:
    """Name of the fragment that a read belongs to: without /1 or /2."""
    return F.regexp_replace(name, "/[0-9]$", "")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(rid, name, anno, offset, len, n_ambiguous): sequences of an index's annotation file, two lines each after a header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where("i > 0 AND line <> ''")
    kept = lines.select(F.floor((F.col("i") - 1) / 2).cast("int").alias("rid"), ((F.col("i") - 1) % 2).alias("k"), "line")
    pairs = kept.groupBy("rid").agg(F.max(F.when(F.col("k") == 0, F.col("line"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("line"))).alias("b"))
    part = lambda k: F.get(F.split("b", r"\s+"), k)
    name, anno = F.regexp_extract("a", r"^\S+\s+(\S+)", 1), F.regexp_extract("a", r"^\S+\s+\S+\s+(.*)$", 1)
    return pairs.select("rid", name.alias("name"), anno.alias("anno"), part(0).cast("long").alias("offset"), part(1).cast("int").alias("len"), part(2).cast("int").alias("n_ambiguous"))


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """(offset, len, letter): stretches of ambiguous bases of an index's hole file, a line each after a header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).where("i > 0 AND line <> ''")
    part = lambda k: F.get(F.split("line", r"\s+"), k)
    return lines.select(part(0).cast("long").alias("offset"), part(1).cast("int").alias("len"), part(2).alias("letter"))
