"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tables import Workspace


#: Edges from which a round's least neighbours are written as a table, so that Spark can split the neighbours of a hub.
TABLES_FROM = 2_000_000


def _toward_least(edges: DataFrame, large: bool, table) -> DataFrame:
    """One star: connect each node's larger (or no larger) neighbours to the least of its neighbourhood.

    ``table`` gives the least ones back, as they are or as a table.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = near.join(least, "u")
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    )
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str, tables_from: int = TABLES_FROM) -> DataFrame:
    """(u, v): every node that has an edge and is not its component's least, with that least node.

    ``edges`` has the long columns u and v.  Rounds are written to the workspace and end when one changes
    nothing; their number grows with the logarithm of the longest path.
    """
    current = work.stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        seen = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen.n == 0 or (seen.n, seen.x) == mark:
            return current
        mark, step, made = (seen.n, seen.x), step + 1, [f"{name}-{step}"]

        def table(df: DataFrame) -> DataFrame:
            if seen.n < tables_from:  # noqa: B023
                return df
            made.append(f"{name}-{step}-{len(made)}")  # noqa: B023
            return work.stash(df, made[-1])  # noqa: B023

        current = work.stash(_toward_least(table(_toward_least(current, True, table)), False, table), f"{name}-{step}")
        for old in made:
            work.drop(old)
