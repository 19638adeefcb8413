"""Candidate enumeration on arrays of spans, with higher-order functions (the parts that need no recursion)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product(slots: Column) -> Column:
    """One alternative of each slot, in all combinations; the last slot varies fastest. slots: array<array<T>>, not empty."""
    first = F.transform(F.get(slots, F.lit(0)), lambda a: F.array(a))
    grow = lambda acc, alternatives: F.flatten(F.transform(acc, lambda e: F.transform(alternatives, lambda a: F.array_append(e, a))))
    return F.aggregate(F.slice(slots, 2, F.greatest(F.size(slots) - 1, F.lit(0))), first, grow)


def proper_subsets(items: Column) -> Column:
    """All subsets but the empty one and the whole, by bit mask from 1 on; none for fewer than two items."""
    most = (F.pow(F.lit(2), F.size(items)) - 2).cast("int")
    masks = F.when(F.size(items) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(most, F.lit(1))))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))


def by_start(values: Column) -> Column:
    """Stable sort of spans by start."""
    marked = F.transform(values, lambda v, i: F.struct(v["st"].alias("st"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(marked), lambda x: x["v"])


def overlaps(sorted_values: Column) -> Column:
    """Whether a span reaches into the next one."""
    return F.exists(F.transform(sorted_values, lambda v, i: v["en"] > F.coalesce(F.get(sorted_values, i + 1)["st"], F.lit(1 << 30))), lambda x: x)
