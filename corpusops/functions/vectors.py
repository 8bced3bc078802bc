"""Column functions over arrays of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNKNOWN


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def named(x: Column, use) -> Column:
    """use(x) with x made once: a one-element array names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def normalize(x: Column) -> Column:
    """Divided by the sum; uniform if the sum is not positive."""
    return named(x, lambda a: named(total(a), lambda s: F.transform(a, lambda p: F.when(s > 0, p / s).otherwise(F.lit(1.0) / F.size(a)))))


def softmax(x: Column) -> Column:
    return normalize(named(x, lambda a: named(F.array_max(a), lambda m: F.transform(a, lambda v: F.exp(v - m)))))


def top_k(probs: Column, classes: Column, k: int) -> Column:
    """array<struct<label, conf>> of the k largest, in falling order; equal ones by place."""
    ranked = F.sort_array(F.transform(probs, lambda p, i: F.struct((-p).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(F.get(classes, x["i"]).alias("label"), (-x["s"]).alias("conf")))


def argmax(x: Column) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def pick_char(probs: Column, classes: Column, least: float = 0.35, blank: str = "<blank>") -> Column:
    best = F.get(classes, argmax(probs))
    return F.when((F.array_max(probs) < least) | (best == blank) | best.isNull(), UNKNOWN).otherwise(best)


def topk_to_probs(topk: Column, classes: Column) -> Column:
    """array<struct<label, conf>> as probabilities by class, renormalised if any is positive."""
    known = F.map_from_entries(topk)
    dense = F.transform(classes, lambda c: F.coalesce(F.element_at(known, c), F.lit(0.0)))
    return named(dense, lambda d: named(total(d), lambda s: F.transform(d, lambda p: F.when(s > 0, p / s).otherwise(p))))


def align_classes(probs: Column, classes: Column, wanted: Column) -> Column:
    known = F.map_from_arrays(classes, probs)
    return F.transform(wanted, lambda c: F.coalesce(F.element_at(known, c), F.lit(0.0)))
