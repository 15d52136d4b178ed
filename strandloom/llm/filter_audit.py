"""Interaction audit of document filters: what each removes at every place of every order, and its Shapley value.

A document is known by the set of filters that it fails, a mask of bits.  Over a part's masks the removal game of a
coalition of filters is the number of documents that fail at least one of them.  Its Hart-Mas-Colell potential P comes
from P(S) = (v(S) + sum of P(S without i)) / |S| over the 32 coalitions; a filter's Shapley value is the grand
coalition's potential minus the potential without that filter, and a step of an order removes the difference of two
coalitions.  Only counts by part and mask leave the documents.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tables import Workspace
from strandloom.llm.tokens import text_slices

_UPPER = bytes(range(65, 91))
_SIGNS = re.compile(rb"[#$%&*|]")

#: A failure condition of a text by itself, from its UTF-8 bytes and its words.
Condition = Callable[[bytes, list[bytes]], bool]


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repeated_words(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(text: bytes, words: list[bytes]) -> bool:
    capitals = len(text) - len(text.translate(None, _UPPER))
    return 100 * capitals > 3 * len(text.decode())


def has_signs(text: bytes, words: list[bytes]) -> bool:
    return _SIGNS.search(text) is not None


#: By letter; the letter after them is for texts that a smaller key has as well.
CONDITIONS: dict[str, Condition] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": has_signs}
COPIES = "E"


def text_masks(
    df: DataFrame, conditions: dict[str, Condition] = CONDITIONS, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(doc_id, part, t, mask) of every row: the failed conditions of the text, bit by bit in their order, and its SHA-256.

    Null text is empty, a null part is the empty string.
    """
    tests = list(conditions.values())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 3):
                masks = []
                for value in rows.column(3).cast(pa.binary()).to_pylist():
                    # bytes.split() splits at 0x20 and 0x09-0x0D only.
                    body = value or b""
                    words = body.split()
                    masks.append(sum(test(body, words) << k for k, test in enumerate(tests)))
                columns = [*(rows.column(k) for k in range(3)), pa.array(masks, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "t", "mask"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("t"),
        body.alias("body"),
    )
    return rows.mapInArrow(judge, "doc_id long, part string, t binary, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame, copies_bit: int, work: Workspace) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled so, with the bit of copies set where it holds.

    A row is a copy where a smaller key has its text.  The least key of each text meets the rows by (text, key), not by
    the text alone, so that a text with very many copies isn't one group; rows that agree in all are counted first.  Null
    keys are no smaller than others and none is smaller than they.  A key has a label where any of its label rows has it.
    """
    rows = work.stash(masks, "masks")
    least = rows.groupBy("t").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_least", F.lit(True))
    counted = rows.groupBy("t", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    met = counted.join(least, ["t", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_least").isNull()
    full = F.col("mask").bitwiseOR(F.when(copy, F.lit(1 << copies_bit)).otherwise(F.lit(0)))
    by_key = met.select("doc_id", "part", full.alias("mask"), "n").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    by_key = work.stash(by_key, "by_key")
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)")
    )
    zero = F.lit(0).cast("long")
    total = by_key.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    marked = by_key.join(marks, "doc_id").select("part", "mask", zero.alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    marked = marked.select("part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return total.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_game(counts: np.ndarray) -> np.ndarray:
    """v(S) for each coalition S (a mask): the documents that fail at least one of its filters."""
    masks = np.arange(len(counts))
    return np.array([counts[(masks & s) != 0].sum() for s in masks])


def potentials(game: np.ndarray) -> list[int]:
    """Hart-Mas-Colell potentials, each times |S|! and so an integer: (|S| - 1)! v(S) + sum over i of that of S without i."""
    found = [0] * len(game)
    for s in range(1, len(game)):
        size = s.bit_count()
        without = sum(found[s ^ 1 << i] for i in range(s.bit_length()) if s >> i & 1)
        found[s] = math.factorial(size - 1) * int(game[s]) + without
    return found


def shapley_sums(game: np.ndarray, filters: int) -> list[int]:
    """For each filter what it removes summed over all orders: filters! times P(all) - P(all without it)."""
    scaled, grand = potentials(game), (1 << filters) - 1
    return [scaled[grand] - filters * scaled[grand ^ 1 << i] for i in range(filters)]


_FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """From (part, mask, n, good, toxic) one row for every part, order of the filters and step in it.

    Parts are names; each has at most 2 ** len(letters) masks, which are gathered in one row before the steps are made.
    """
    filters = len(letters)
    orders = list(itertools.permutations(range(filters)))
    names = ["".join(letters[i] for i in order) for order in orders for _ in order]
    steps = [k + 1 for order in orders for k in range(filters)]
    own = np.array([i for order in orders for i in order])
    before = np.array([sum(1 << i for i in order[:k]) for order in orders for k in range(filters)])
    upto = before | 1 << own

    def rows_of(part: str, found: list[dict]) -> list[pa.Array]:
        table = np.zeros((3, 1 << filters), np.int64)
        for x in found:
            table[:, x["mask"]] = x["n"], x["good"], x["toxic"]
        games = [removal_game(counts) for counts in table]
        removed, good, toxic = (g[upto] - g[before] for g in games)
        failing = games[0][1 << own]  # a coalition of one removes all that fail it
        values = {
            "kept": table[0].sum() - games[0][upto],
            "removed": removed,
            "redundant": failing - removed,
            "unique_fails": table[0][1 << own],
            "good_lost": good,
            "toxic_lost": toxic,
            "shapley": np.array(shapley_sums(games[0], filters))[own],
        }
        return [pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *(pa.array(values[f], pa.int64()) for f in _FIELDS)]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(rows_of(part, found), ["part", "filter_order", "step", *_FIELDS])

    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    return gathered.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in _FIELDS))


def audit(
    df: DataFrame, labels: DataFrame, conditions: dict[str, Condition] = CONDITIONS, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """The audit of the conditions, with copies as the last filter, over ``df``; an empty table has no part and no row.

    ``labels`` has doc_id, quality and toxic; null labels are none.  Other columns of both stay unread.
    """
    work = Workspace(df.sparkSession)
    counts = mask_counts(text_masks(df, conditions, key, text, part), labels, len(conditions), work)
    return audit_orders(counts, "".join(conditions) + COPIES)
