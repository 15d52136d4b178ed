"""Array expressions: values bound once, and running totals whose cost stays near the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Combine = Callable[[Column, Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(a: Column, b: Column) -> Column:
    return a + b


def largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, combine: Combine = total, kind: str = "int") -> Column:
    """For each of non-negative values all before it, combined from 0 (empty and null arrays: empty).

    A fold that appends to an array copies it at every step, so the values are folded by pieces of about the square
    root of their number, and the pieces' totals after them.
    """
    zero, none = F.lit(0).cast(kind), F.array().cast(f"array<{kind}>")

    def fold(items: Column, of: Callable[[Column], Column]) -> Column:
        add = lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, F.struct(zero.alias("at"), none.alias("out")), add)

    def whole(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")

        def by_step(n: Column) -> Column:
            begins = F.sequence(F.lit(1), F.size(v), n)
            return let(F.transform(begins, lambda b: fold(F.slice(v, b, n), lambda x: x)), joined)

        return F.when(F.size(v) > 1, let(step, by_step)).when(F.size(v) == 1, F.array(zero)).otherwise(none)

    def joined(parts: Column) -> Column:
        def shifted(bases: Column) -> Column:
            return F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda y: combine(F.get(bases, i), y))))

        return let(fold(parts, lambda p: p["at"])["out"], shifted)

    return let(values.cast(f"array<{kind}>"), whole)
