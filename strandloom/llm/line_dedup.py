"""Line dedup by levelled sorted runs of line keys.

Lines are known by a 128-bit hash of their key: the line without white space at both ends, A-Z lower-cased.  A run is
a table of (key, docs), one row a key, bucketed and sorted by key.  Each new batch of documents counts its own keys,
anti-joins the runs' settled keys (those that already reached the bound, whose count need not grow), and is added as
a run of level 0; ``fanout`` runs of one level are merged into one of the next, so a key is rewritten as often as
there are levels.  Runs share their buckets: neither the anti-join nor the merge moves a run through a shuffle.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.tables import Workspace
from strandloom.llm.tokens import text_slices

#: Documents from which on a key's lines are dropped.
MIN_DOCS = 10
#: Batches that a stored table is added in, and runs of a level that are merged into one.
BATCHES, FANOUT = 8, 4
#: Most keys (16 bytes each) that are sent to every task; beyond, texts meet their keys by joins.
BROADCAST_KEYS = 200_000


def line_keys(text: bytes) -> list[bytes]:
    """For each line its key's 128-bit hash; empty for a line without a key."""
    # bytes.strip() and lower() know exactly 0x20, 0x09-0x0D and A-Z.
    return [xxhash.xxh3_128_digest(key) if (key := line.strip().lower()) else b"" for line in text.split(b"\n")]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def count_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, docs): in how many rows of ``df`` each key is; summed by slice, then by task, before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                found = Counter(key for t in _texts(part, 0) for key in set(line_keys(t)))
                found.pop(b"", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "docs"]
                )

    counted = df.select(f"`{text}`").mapInArrow(count, "key binary, docs long")
    return counted.groupBy("key").agg(F.sum("docs").alias("docs"))


class LineRuns:
    """The runs of all batches added so far, in the shared folder; ``drop`` removes them.

    A level is a table and a run a set of its files, so that a scan of the level finds a key's rows of all its runs in
    one bucket.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self._spark, self._min_docs, self._fanout = spark, min_docs, fanout
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._work = Workspace(spark)
        #: For each level its table's name and how many runs it has.
        self.levels: list[tuple[str, int]] = []

    def _append(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append(("", 0))
        name, runs = self.levels[level]
        name = name or f"line_runs_{uuid.uuid4().hex}"
        # An external table: its files are in the shared folder, the catalog only knows its buckets.
        writer = run.write.mode("append").format("parquet").bucketBy(self._buckets, "key").sortBy("key")
        writer.option("path", self._work.path(name)).saveAsTable(name)
        self.levels[level] = name, runs + 1

    def rows(self, level: int) -> DataFrame:
        """(key, docs) of a level's runs, a row for each key in each run."""
        return self._spark.table(self.levels[level][0])

    def _merge(self, level: int, into: int) -> None:
        """All runs of a level as one run of a higher one; a key's rows are summed within its bucket."""
        self._append(self.rows(level).groupBy("key").agg(F.sum("docs").alias("docs")), into)
        self._forget(level)

    def _forget(self, level: int) -> None:
        name, _ = self.levels[level]
        if name:
            self._spark.sql(f"DROP TABLE {name}")
            self._work.drop(name)
        self.levels[level] = "", 0

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (key, docs), one row a key, as a run of level 0; full levels are merged upwards."""
        for level, (_, runs) in enumerate(self.levels):
            if runs:
                settled = self.rows(level).where(F.col("docs") >= self._min_docs).select("key")
                counts = counts.join(settled, "key", "left_anti")
        self._append(counts, 0)
        level = 0
        while self.levels[level][1] >= self._fanout:
            self._merge(level, level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(key) of at least ``min_docs`` documents over all runs; lower levels are merged into the highest for it."""
        if not self.levels:
            return self._spark.createDataFrame([], "key binary")
        top = len(self.levels) - 1
        for level in range(top):
            if self.levels[level][1]:
                self._merge(level, top)
        return self.rows(top).groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= self._min_docs).select("key")

    def drop(self) -> None:
        for level in range(len(self.levels)):
            self._forget(level)
        self.levels = []


def file_batches(df: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A stored Parquet table as at most ``batches`` DataFrames over about as many of its files each, in their order."""
    files = sorted(urllib.parse.unquote(f) for f in df.inputFiles())
    step = -(-len(files) // batches) or 1
    reader = df.sparkSession.read.schema(df.schema)
    return [reader.parquet(*files[at : at + step]) for at in range(0, len(files), step)]


def drop_lines(
    df: DataFrame, frequent: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """``keep``, n_lines, n_dropped and the kept lines as ``kept``, for every row; other columns stay unread.

    Lines whose key is in ``frequent`` (key, one row each) go, the others are joined by line feeds; null and empty
    texts are one empty line, which has no key.  Keys that aren't many are counted and sent to every task; else each
    different text meets its keys by a join on the key, and the rows meet their text's keys by a join on its hash.
    """
    spark = df.sparkSession
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{types}, n_lines long, n_dropped long, kept string"
    n = len(keep)
    known = None
    if frequent.limit(broadcast_keys + 1).count() <= broadcast_keys:
        known = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in frequent.collect()))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, n):
                own = known.value if known is not None else part.column(n + 1).to_pylist()
                yield _stripped(part, n, own, known is None)

    rows = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("l_text"))
    if known is not None:
        return rows.mapInArrow(strip, schema)
    rows = rows.withColumn("l_hash", F.unhex(F.sha2(F.coalesce("l_text", F.lit("")), 256)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                of = [(h, k) for h, t in zip(part.column(1).to_pylist(), _texts(part, 0), strict=True) for k in set(line_keys(t)) if k]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in of], pa.binary()), pa.array([k for _, k in of], pa.binary())], ["l_hash", "key"])

    work = Workspace(spark)
    met = rows.select("l_text", "l_hash").mapInArrow(pairs, "l_hash binary, key binary").distinct()
    met = work.stash(met, "pairs").join(work.stash(frequent, "frequent"), "key", "left_semi")
    drops = work.stash(met.groupBy("l_hash").agg(F.collect_list("key").alias("l_keys")), "drops")
    work.drop("pairs")
    joined = rows.join(drops, "l_hash", "left").select(*[f"`{c}`" for c in keep], "l_text", "l_keys")
    return joined.mapInArrow(strip, schema)


def _stripped(part: pa.RecordBatch, at: int, own, by_row: bool) -> pa.RecordBatch:
    lines, dropped, kept = [], [], []
    for r, text in enumerate(_texts(part, at)):
        goes = frozenset(own[r] or ()) if by_row else own
        every = text.split(b"\n")
        stays = [line for line, key in zip(every, line_keys(text), strict=True) if key not in goes]
        lines.append(len(every))
        dropped.append(len(every) - len(stays))
        kept.append(b"\n".join(stays))
    columns = [part.column(k) for k in range(at)]
    columns += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*part.schema.names[:at], "n_lines", "n_dropped", "kept"])


def dedup_lines(batches: Iterable[DataFrame], df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``drop_lines`` on ``df`` of the keys that at least ``min_docs`` rows of all batches hold."""
    runs = LineRuns(df.sparkSession, min_docs)
    for batch in batches:
        runs.add(count_keys(batch, text))
    stripped = drop_lines(df, runs.frequent(), keep, text)
    runs.drop()  # what the result needs of them was sent or stored
    return stripped
