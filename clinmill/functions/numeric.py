"""Numeric expressions: ordered categories, softmax, decisions, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def looked_up(value: Column, table: dict) -> Column:
    """A value by a small table; null for others."""
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in table.items()))


def banded(value: Column, bands: list[tuple[float, object]]) -> Column:
    """The entry of the first band whose exclusive upper end is above the value; null for null."""
    out = F.lit(None)
    for upper, entry in reversed(bands):
        out = F.when(value < upper, F.lit(entry)).otherwise(out)
    return F.when(value.isNotNull(), out)


def ordinal_gap(a: Column, b: Column, order: list[str]) -> Column:
    """Steps from category ``b`` to category ``a``; null for unknown ones."""
    rank = {v: i for i, v in enumerate(order)}
    return looked_up(a, rank) - looked_up(b, rank)


def most_urgent(items: Column, order: list[str]) -> Column:
    """The item that comes first in the order; null for none."""
    rank = {v: i for i, v in enumerate(order)}
    best = F.array_min(F.transform(items, lambda x: looked_up(x, rank)))
    return F.get(F.array(*map(F.lit, order)), best)


def softmax(logits: Column, digits: int = 4) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: F.round(x / total, digits))


def argmax(values: Column) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decided(probabilities: Column, threshold: float = 0.30, first: int = 0) -> Column:
    """The class ``first`` if it reaches the threshold, else the most probable."""
    return F.when(F.get(probabilities, F.lit(first)) >= threshold, first).otherwise(argmax(probabilities))


def by_index(sorted_values: Column, q: float) -> Column:
    """The element at index int(q * (n - 1)) of a sorted array."""
    return F.get(sorted_values, F.floor(F.lit(q) * (F.size(sorted_values) - 1)).cast("int"))


def wilson(k: Column, n: Column, z: float = 1.96, digits: int = 4) -> Column:
    """struct(bas, haut): the Wilson interval of a share; nulls for n = 0."""
    kk, nn = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = kk / nn, z * z
    centre = (p + zz / (2 * nn)) / (1 + zz / nn)
    half = z * F.sqrt(p * (1 - p) / nn + zz / (4 * nn * nn)) / (1 + zz / nn)
    # least and greatest skip nulls
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(F.when(nn.isNotNull(), F.round(low, digits)).alias("bas"), F.when(nn.isNotNull(), F.round(high, digits)).alias("haut"))
