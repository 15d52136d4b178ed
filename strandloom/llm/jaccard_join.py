"""Exact n-gram Jaccard join and its components.

Documents are rows and five-word shingles columns of a sparse incidence matrix; two documents link when
100 * intersection >= 75 * union.  Texts of one shingle set are one row (a class), so copies cost nothing.

1.  Shingles are put in one order for all documents, rare ones first.  By the size bounds, two linked sets
    share a shingle within the first n - ceil(6n/7) + 1 of the smaller and n - ceil(3n/4) + 1 of the larger
    (the order decides only how many candidates there are, never which links are found).
2.  In every column of that reduced matrix each class is paired with the nearest smaller one and with the
    smallest that the bounds allow: a few pairs a row, whatever the column's size.  A parity bitmap of each set
    bounds the overlap from above and discards most pairs; the overlaps of the others are counted by blocks of the
    product, and pairs below the bound discarded.  The links found give provisional components.
3.  Pairs of one column that lie in different components, and that size and position bounds allow, are counted
    in the same way.  Pairs inside a component need no count: they can't change the components.  As one of such a
    pair is outside the column's largest component, those few meet all, not all meet all.

Columns that very many classes share are dealt to several tasks by a hash of the class, and step 2 streams through a
column, so that no column is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.components import connected_components
from strandloom.llm.tables import Workspace
from strandloom.llm.tokens import SLICE_BYTES, mix64, shingle_sets

#: Most frequent shingles whose counts order the columns; all others count as rare.
FREQUENT_SHINGLES = 200_000
FREQUENT_FROM = 8
#: Shingles that a task counts together before it passes on those that it met more than once.
COUNT_WINDOW = 2_000_000
#: Pairs of one block of the product, about.
BLOCK_PAIRS = 2_000
#: Least bits of a set's parity bitmap.
LEAST_BITS = 512
#: Classes of a column, by its count, from which the column is dealt to several tasks; each gets about so many.
HOT_COLUMN = 50_000
#: Classes whose postings a task remembers, so as not to emit them again for copies.
SEEN_CLASSES = 200_000
#: Rows of candidate ids up to which they are broadcast to the scan of the texts; joined by shuffle beyond.
BROADCAST_IDS = 500_000


_WORD = (1 << 64) - 1


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a shingle set; equal sets have equal keys."""
    x = int(np.add.reduce(mix64(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)))) ^ len(shingles)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD  # mix64 of one number
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def parity(shingles: np.ndarray) -> bytes:
    """Bitmap of which buckets hold an odd number of the set's shingles: a power of two of them, about two a shingle.

    Two bitmaps of one size differ in at most as many bits as the sets have shingles not in common, and the
    halves of a bitmap put together by exclusive or are that of half as many buckets.
    """
    size = max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    place = (shingles & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=size) & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the larger folded to the smaller's size."""
    x, y = (np.frombuffer(k, np.uint8) for k in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(k.reshape(-1, size), axis=0) for k in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


#: Buckets of the parity bitmap that travels with a row of the matrix; sets together of up to three and a half times as
#: many shingles are told apart by it.
MARK_BITS = 512


def mark(shingles: np.ndarray) -> bytes:
    """``parity`` with a fixed number of buckets."""
    place = (shingles & np.uint64(MARK_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=MARK_BITS) & 1, bitorder="little").tobytes()


def min_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection with which sets of n and m shingles link: 7 * overlap >= 3 * (n + m)."""
    return -(-3 * (n + m) // 7)


def _row_name(key: str, text: str) -> Column:
    """Text that leads back to a row: its key and a hash of its text, as keys may be null or repeat."""
    return F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(":"), F.hex(F.xxhash64(F.col(f"`{text}`"))))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bits, marks = [], [], [], []
        for found in shingle_sets(batch.column(1)):
            sizes.append(len(found))
            keys.append(set_key(found))
            bits.append(parity(found) if len(found) else None)
            marks.append(mark(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())],
            ["doc_id", "row_name", "n_shingles", "cls", "bits", "mark"],
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles met more than once within a window of the task, copies of a set counting once."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def counted() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        more = times > 1
        return pa.RecordBatch.from_arrays([pa.array(found[more].view(np.int64)), pa.array(times[more].astype(np.int64))], ["h", "n"])

    for batch in batches:
        for found in shingle_sets(batch.column(0)):
            if not len(found):
                continue
            key = hash((len(found), int(found[0]), int(found[-1]), int(np.add.reduce(found))))  # a guess is enough for a count
            if key in seen:
                continue
            seen.add(key)
            held.append(found)
            size += len(found)
            if size >= COUNT_WINDOW:
                yield counted()
                held, size = [], 0
                seen.clear()
    if held:
        yield counted()


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, the less frequent first, and their counts: at most FREQUENT_SHINGLES, whatever the input."""
    top = (
        texts.mapInArrow(_repeated, "h long, n long")
        .groupBy("h")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "h")
        .limit(FREQUENT_SHINGLES)
        .toArrow()
    )
    return top.column("h").to_numpy().view(np.uint64)[::-1].copy(), top.column("n").to_numpy()[::-1].copy()


def _postings(shared, hot: int):
    """Rows of the reduced matrix; lead marks the shorter prefix of the smaller set.

    A class is emitted once by a task, however many copies it reads.  A column counted ``hot`` times or more is dealt
    in ``parts``, and ``part`` is the class's, by a hash of both.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        by_hash = np.argsort(frequent)
        known, times = frequent[by_hash], counts[by_hash]
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for found in shingle_sets(batch.column(0)):
                n = len(found)
                if not n:
                    continue
                key = set_key(found)
                if key in seen:
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(key)
                at = np.searchsorted(known, found)
                hit = np.zeros(n, bool)
                if len(known):
                    hit = known[np.minimum(at, len(known) - 1)] == found
                common = found[hit][np.argsort(by_hash[at[hit]])]
                length = n - -(-3 * n // 4) + 1
                prefix = np.concatenate([found[~hit][:length], common])[:length]
                parts = np.ones(len(prefix), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
                    parts = np.where(known[place] == prefix, np.maximum(1, times[place] // hot), 1)
                out.append((prefix, key, n, n - -(-6 * n // 7) + 1, parts))
                if len(out) >= 512:
                    yield _posting_batch(out)
                    out = []
            if out:
                yield _posting_batch(out)

    return emit


def _posting_batch(rows: list[tuple]) -> pa.RecordBatch:
    lengths = np.array([len(r[0]) for r in rows])
    pos = np.concatenate([np.arange(k, dtype=np.int64) for k in lengths])
    spread = lambda k, kind: np.repeat(np.array([r[k] for r in rows], kind), lengths)
    h, cls, parts = np.concatenate([r[0] for r in rows]), spread(1, np.int64), np.concatenate([r[4] for r in rows])
    part = (mix64(h ^ cls.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    at = spread(2, np.int64) << 32 | pos << 1 | (pos < spread(3, np.int64))
    columns = [pa.array(h.view(np.int64)), pa.array(cls), pa.array(at), pa.array(parts << 32 | part)]
    return pa.RecordBatch.from_arrays(columns, ["h", "cls", "at", "deal"])


#: ``at`` is n, pos and lead, and ``deal`` parts and part, from high bits to low: a row of four numbers is shuffled.
_POSTING = "h long, cls long, at long, deal long"
_SHARED = "h long, cls long, n int, pos int, lead boolean, parts int, part int, near long, far long"


class _Column:
    """What step 2 remembers of the column it reads: its last row that leads, and the first of each size."""

    def __init__(self):
        self.last: tuple[int, int] | None = None
        self.sizes: list[int] = []
        self.firsts: list[int] = []
        self.low = 0

    def partners(self, n: int) -> tuple[int | None, int | None]:
        """The nearest smaller class that leads and the smallest, both within the size bound."""
        while self.low < len(self.sizes) and 4 * self.sizes[self.low] < 3 * n:
            self.low += 1
        near = self.last[0] if self.last and 4 * self.last[1] >= 3 * n else None
        return near, self.firsts[self.low] if self.low < len(self.sizes) else None

    def add(self, cls: int, n: int) -> None:
        self.last = (cls, n)
        if not self.sizes or self.sizes[-1] != n:
            self.sizes.append(n)
            self.firsts.append(cls)


def _met(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows may share their column with another class; the first and the last may, as far as a batch tells."""
    h, deal, cls = (batch.column(k).to_numpy() for k in ("h", "deal", "cls"))
    same = (h[1:] == h[:-1]) & (deal[1:] == deal[:-1])
    edge = np.ones(min(1, len(h)), bool)
    keep = np.concatenate([edge, same]) | np.concatenate([same, edge]) | (deal >> 32 > 1)
    keep[1:] &= ~(same & (cls[1:] == cls[:-1]))  # copies follow each other
    keep[-1:] = True
    return keep


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of columns (h, deal), or of dealt columns, with at least two classes, with the partners of step 2.

    The rows come sorted by h, deal, at, cls.  They are passed on as they come, the first of a column when its second is
    read, so that no column is held whole.
    """
    names = ["h", "cls", "n", "pos", "lead", "parts", "part"]
    held, before, column, alone = None, None, _Column(), True
    for batch in batches:
        out: list[list] = []
        batch = batch.filter(pa.array(_met(batch)))
        at, deal = batch.column("at").to_numpy(), batch.column("deal").to_numpy()
        fields = (batch.column("h"), batch.column("cls"), at >> 32, at >> 1 & 0x7FFFFFFF, at & 1 > 0, deal >> 32, deal & 0xFFFFFFFF)
        rows = zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in fields), strict=True)
        for row in rows:
            h, cls, n, _, lead, parts, part = row
            if (h, part) != before:
                before, column, held, alone = (h, part), _Column(), [*row, None, None], parts == 1
                if not alone:  # its other parts have more classes
                    out.append(held)
            elif cls == held[1]:
                continue  # copies follow each other
            else:
                if alone:
                    out.append(held)
                    alone = False
                held = [*row, *column.partners(n)]
                out.append(held)
            if lead:
                column.add(cls, n)
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "near", "far"])


#: Rows of one column compared at a time by step 3, and pairs whose marks are.
_TILE, _MARKED = 2048, 1 << 16


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a column in different components that the size and position bounds and their marks allow.

    Rows come sorted by h, part, few: first those outside the column's largest component (few), which are held, then
    all of the part.  In any pair sought one is among the first.
    """
    names = ["h", "part", "few_part", "cls", "n", "pos", "lead", "root", "major"]
    before, few = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in [*names, "few"]}
        marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        changes = [part[k][1:] != part[k][:-1] for k in ("h", "part", "few_part")]
        bounds = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(changes), [True]]))
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(int(part[k][a]) for k in ("h", "part", "few_part"))
            rows = {k: part[k][a:b] for k in names}
            rows["mark"] = marks[a:b]
            is_few = part["few"][a:b]
            fresh = {k: v[is_few] for k, v in rows.items()}
            few = fresh if key != before else {k: np.concatenate([few[k], fresh[k]]) for k in fresh}
            before = key
            yield from _across(few, {k: v[~is_few] for k, v in rows.items()})


def _across(few: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for left in range(0, len(few["cls"]), _TILE):
        x = {k: v[left : left + _TILE][:, None] for k, v in few.items() if k != "mark"}
        for right in range(0, len(rows["cls"]), _TILE):
            y = {k: v[right : right + _TILE][None, :] for k, v in rows.items() if k != "mark"}
            nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
            first = (nx < ny) | ((nx == ny) & (x["cls"] < y["cls"]))  # the row of few is the smaller set
            small, large = np.where(first, nx, ny), np.where(first, ny, nx)
            reach = 1 + np.minimum(nx - x["pos"] - 1, ny - y["pos"] - 1)
            fits = (x["root"] != y["root"]) & np.where(first, x["lead"], y["lead"])
            fits &= first | (y["root"] == y["major"])  # a pair of two of few is met twice
            fits &= (4 * small >= 3 * large) & (reach >= min_overlap(nx, ny))
            i, j = np.nonzero(fits)
            for some in range(0, len(i), _MARKED):
                u, v = i[some : some + _MARKED], j[some : some + _MARKED]
                apart = np.bitwise_count(few["mark"][left + u] ^ rows["mark"][right + v]).sum(1, dtype=np.int64)
                kept = 7 * apart <= nx[u, 0] + ny[0, v]
                fits[u[~kept], v[~kept]] = False
            i, j = np.nonzero(fits)
            if len(i):
                a, b, swap = few["cls"][left + i], rows["cls"][right + j], ~first[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b))], ["x", "y"])


def _several_roots(labelled: DataFrame, work: Workspace) -> DataFrame:
    """Rows of the columns that have several components; these columns are a table, so that Spark can split hot ones."""
    ends = labelled.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return labelled.join(work.stash(ends.where("low <> high").select("h"), "mixed"), "h", "left_semi")


def _open_columns(labelled: DataFrame, work: Workspace) -> DataFrame:
    """Rows of columns that have several components, dealt for ``_open_pairs``.

    A column's rows outside its largest component go to each of its parts, in pieces of about HOT_COLUMN.
    """
    counts = labelled.groupBy("h", "root").agg(F.count("*").alias("c"))
    mixed = (
        counts.groupBy("h")
        .agg(F.max_by("root", F.struct("c", "root")).alias("major"), (F.sum("c") - F.max("c")).alias("fewer"))
        .select(F.col("h").alias("m_h"), "major", (F.floor(F.col("fewer") / HOT_COLUMN) + 1).cast("int").alias("few_parts"))
    )
    rows = labelled.join(work.stash(mixed, "majors"), F.col("h") == F.col("m_h")).drop("m_h")
    own = F.pmod(F.xxhash64("cls", "h"), F.col("few_parts")).cast("int")
    every = rows.withColumn("few_part", F.explode(F.sequence(F.lit(0), F.col("few_parts") - 1))).withColumn("few", F.lit(False))
    few = rows.where("root <> major").withColumn("few_part", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("few", F.lit(True))
    kept = ["h", "part", "few_part", "few", "cls", "n", "pos", "lead", "root", "major"]
    return few.select(kept).unionByName(every.select(kept))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of the incidence matrix for each block that needs it, in batches of about SLICE_BYTES."""
    block, cls, sets, held = [], [], [], 0

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(cls, pa.int64()), pa.nulls(len(cls), pa.int64()), pa.array(sets, pa.binary())],
            ["block", "x", "y", "row"],
        )

    for batch in batches:
        for found, key, blocks in zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if set_key(found) != key:  # another text under the same key
                continue
            row = found.tobytes()
            for b in blocks.as_py():
                block.append(b)
                cls.append(key)
                sets.append(row)
                held += len(row)
                if held >= SLICE_BYTES:
                    yield taken()
                    block, cls, sets, held = [], [], [], 0
    yield taken()


def _block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts overlaps of a block's pairs and yields its links; a block's rows come before its pairs."""
    block, rows, pairs = None, {}, []
    for batch in batches:
        for b, x, y, row in zip(*(batch.column(k).to_pylist() for k in ("block", "x", "y", "row")), strict=True):
            if b != block:
                if pairs:
                    yield _links(rows, pairs)
                block, rows, pairs = b, {}, []
            if row is not None:
                rows[x] = np.frombuffer(row, np.uint64)
            else:
                pairs.append((x, y))
    if pairs:
        yield _links(rows, pairs)


#: Rows that are multiplied together.
_ROWS_AT_ONCE = 64


def _links(rows: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """One block of the product: the row of each y times the rows of its partners, only where asked for.

    A block has all or many of the pairs of its y, so that few rows are marked.
    """
    keys = list(rows)
    place = {k: i for i, k in enumerate(keys)}
    lengths = np.array([len(rows[k]) for k in keys], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    _, columns = np.unique(np.concatenate([rows[k] for k in keys]), return_inverse=True)
    mark = np.zeros(int(columns.max()) + 1, bool)
    by_y: dict[int, list[int]] = {}
    for x, y in pairs:
        by_y.setdefault(y, []).append(x)
    u, v = [], []
    for y, partners in by_y.items():
        i = place[y]
        own = columns[start[i] : start[i + 1]]
        mark[own] = True
        xs = np.array([place[x] for x in partners])
        for some in range(0, len(xs), _ROWS_AT_ONCE):
            j = xs[some : some + _ROWS_AT_ONCE]
            n = lengths[j]
            begins = np.cumsum(n) - n
            hits = mark[columns[np.repeat(start[j] - begins, n) + np.arange(int(n.sum()))]]
            counts = np.add.reduceat(hits, begins, dtype=np.int64)
            for k in np.flatnonzero(7 * counts >= 3 * (lengths[i] + n)).tolist():
                u.append(partners[some + k])
                v.append(y)
        mark[own] = False
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _differ_little(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow a link: 7 * (shingles not in common) <= n + m."""
    for batch in batches:
        if not batch.num_rows:
            continue
        apart = np.array(list(map(bits_apart, *(batch.column(k).to_pylist() for k in ("x_bits", "y_bits")))), np.int64)
        both = batch.column("x_n").to_numpy() + batch.column("y_n").to_numpy()
        yield batch.select(["x", "y"]).filter(pa.array(7 * apart <= both))


def _bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) that the bitmaps of their sets do not rule out.

    Both sides of each join are tables, so that Spark can split a class with very many partners.
    """
    side = lambda k: classes.select(F.col("cls").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_n", "y_n", "x_bits", "y_bits").mapInArrow(_differ_little, "x long, y long")


def _count_pairs(pairs: DataFrame, total: int, docs: DataFrame, reps: DataFrame, partitions: int) -> DataFrame:
    """Links among ``pairs`` (x, y), by blocks of the larger class's key; one with more pairs than a block has several."""
    blocks = max(partitions, -(-total // BLOCK_PAIRS))
    hubs = pairs.groupBy(F.col("y").alias("h_y")).agg(F.count("*").alias("h_n")).where(F.col("h_n") > BLOCK_PAIRS)
    if total // BLOCK_PAIRS <= BROADCAST_IDS:  # there are no more hubs than that
        hubs = F.broadcast(hubs)
    share = F.when(F.col("h_n").isNotNull(), F.pmod(F.xxhash64("x"), F.ceil(F.col("h_n") / BLOCK_PAIRS))).otherwise(0)
    dealt = pairs.join(hubs, F.col("y") == F.col("h_y"), "left").select("x", "y", F.pmod(F.xxhash64("y", share), F.lit(blocks)).cast("int").alias("block"))
    needs = (
        dealt.select(F.col("x").alias("cls"), "block")
        .unionByName(dealt.select(F.col("y").alias("cls"), "block"))
        .groupBy("cls")
        .agg(F.collect_set("block").alias("blocks"))
    )
    wanted = needs.join(reps.select("cls", "rep"), "cls").select("rep", "cls", "blocks")
    if 2 * total <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("row_name") == F.col("rep")).select("text", "cls", "blocks")
    rows = texts.mapInArrow(_with_sets, "block int, x long, y long, row binary")
    asked = dealt.select("block", "x", "y", F.lit(None).cast("binary").alias("row"))
    return (
        rows.unionByName(asked)
        .repartition(partitions, "block")
        .sortWithinPartitions("block", F.col("y").isNotNull())
        .mapInArrow(_block_products, "u long, v long")
    )


def _placed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, Workspace]:
    """Rows (doc_id, row_name, n_shingles, cls), and (cls, root, component_id) of the classes with shingles."""
    spark = df.sparkSession
    work = Workspace(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), _row_name(key, text).alias("row_name"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = work.stash(
        docs.select("doc_id", "text", "row_name").mapInArrow(_sizes, f"doc_id {kind}, row_name string, n_shingles long, cls long, bits binary, mark binary"), "sized"
    )
    reps = work.stash(
        sized.where("n_shingles > 0")
        .groupBy("cls")
        .agg(F.min("row_name").alias("rep"), F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n_shingles"), F.min("bits").alias("bits"), F.min("mark").alias("mark")),
        "classes",
    )

    order = spark.sparkContext.broadcast(frequent_shingles(docs.select("text")))
    matrix = (
        docs.select("text")
        .mapInArrow(_postings(order, HOT_COLUMN), _POSTING)
        .repartition(partitions, "h", "deal")
        .sortWithinPartitions("h", "deal", "at", "cls")
        .mapInArrow(_shared_columns, _SHARED)
    )
    shared = work.stash(matrix, "shared")
    first = work.stash(
        shared.select(F.col("near").alias("x"), F.col("cls").alias("y"))
        .unionByName(shared.select(F.col("far").alias("x"), F.col("cls").alias("y")))
        .where("x IS NOT NULL AND x <> y")
        .distinct(),
        "first",
    )
    bounded = work.stash(_bounded_pairs(first, reps), "bounded-1")
    total = bounded.count()
    links = work.stash(_count_pairs(bounded, total, docs, reps, partitions), "links-1")
    roots = connected_components(links, work, "roots-1")

    labelled = (
        shared.drop("near", "far")
        .join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    labelled = work.stash(_several_roots(labelled, work), "labelled")
    work.drop("shared")
    second = work.stash(
        _open_columns(labelled, work)
        .join(reps.select("cls", "mark"), "cls")
        .repartition(partitions, "h", "part", "few_part")
        .sortWithinPartitions("h", "part", "few_part", F.col("few").desc())
        .mapInArrow(_open_pairs, "x long, y long")
        .distinct()
        .join(first, ["x", "y"], "left_anti"),
        "second",
    )
    for old in ("mixed", "majors", "labelled"):
        work.drop(old)
    bounded = work.stash(_bounded_pairs(second, reps), "bounded-2")
    total = bounded.count()
    if total:
        more = work.stash(_count_pairs(bounded, total, docs, reps, partitions), "links-2")
        roots = connected_components(more.unionByName(roots.select("u", "v")), work, "roots-2")

    named = reps.select("cls", "least_id").join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    # A table, so that Spark can split a large component in the join.
    least = work.stash(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    for old in ("first", "bounded-1", "links-1", "second", "bounded-2"):
        work.drop(old)
    return sized, named.join(least, "root").select("cls", "root", "component_id"), work


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    Null and empty texts, and texts without words, have no shingles and are components of their own; so is a
    row without links.  Rows of one key and different texts are treated as different documents of one name; null keys
    never name a component unless all its keys are null.
    """
    sized, places, _ = _placed(df, key, text)
    linked = sized.where("n_shingles > 0").join(places, "cls").select("doc_id", "n_shingles", "component_id")
    alone = sized.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without all but one of each component: the one of least key (null last), then text hash.

    A row that repeats the kept one, with its key and text, goes too; rows without words stay.
    """
    sized, places, work = _placed(df, key, text)
    linked = sized.where("n_shingles > 0").join(places.select("cls", "root"), "cls")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_name")
    counted = linked.groupBy("root", "doc_id", "row_name").agg(F.count("*").alias("n"))
    first = work.stash(counted.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.row_name").alias("kept")), "kept")
    marked = counted.join(first, "root").withColumn("lost", F.col("row_name") != F.col("kept"))
    marks = work.stash(
        marked.where("lost OR n > 1").select(F.col("row_name").alias("j_name"), "lost").groupBy("j_name").agg(F.min("lost").alias("j_lost")), "marks"
    )
    total = marks.count()
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("j_own"), _row_name(key, text).alias("j_row"))
    joined = named.join(F.broadcast(marks) if total <= BROADCAST_IDS else marks, F.col("j_row") == F.col("j_name"), "left")
    kept = joined.where("j_lost IS NULL")
    again = joined.where("NOT j_lost").dropDuplicates(["j_row"])
    if marks.where("NOT j_lost").isEmpty():
        return kept.select("j_own.*")
    return kept.select("j_own.*").unionByName(again.select("j_own.*"))
