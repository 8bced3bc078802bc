"""Column functions over boxes. A box is a struct of doubles x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def _within(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def to_yolo(b: Column, w: Column, h: Column, clamp: bool = True) -> Column:
    fit = (lambda x: _within(x, 0.0, 1.0)) if clamp else (lambda x: x)
    return F.struct(fit((b["x1"] + b["x2"]) / 2 / w).alias("cx"), fit((b["y1"] + b["y2"]) / 2 / h).alias("cy"), fit((b["x2"] - b["x1"]) / w).alias("w"), fit((b["y2"] - b["y1"]) / h).alias("h"))


def from_yolo(cx: Column, cy: Column, bw: Column, bh: Column, w: Column, h: Column) -> Column:
    return F.when(w.isNotNull() & h.isNotNull(), box((cx - bw / 2) * w, (cy - bh / 2) * h, (cx + bw / 2) * w, (cy + bh / 2) * h))


def from_pct(x: Column, y: Column, bw: Column, bh: Column, w: Column, h: Column) -> Column:
    return F.when(w.isNotNull() & h.isNotNull(), box(x / 100 * w, y / 100 * h, (x + bw) / 100 * w, (y + bh) / 100 * h))


def to_pct(b: Column, w: Column, h: Column) -> Column:
    return F.struct((b["x1"] / w * 100).alias("x"), (b["y1"] / h * 100).alias("y"), ((b["x2"] - b["x1"]) / w * 100).alias("width"), ((b["y2"] - b["y1"]) / h * 100).alias("height"))


def clamp_box(b: Column, w: Column, h: Column) -> Column:
    """Whole pixels inside the image, at least one wide and high."""
    x1, y1 = _within(F.bround(b["x1"]), 0.0, (w - 1).cast("double")), _within(F.bround(b["y1"]), 0.0, (h - 1).cast("double"))
    x2, y2 = F.least(F.greatest(F.bround(b["x2"]), x1 + 1), w.cast("double")), F.least(F.greatest(F.bround(b["y2"]), y1 + 1), h.cast("double"))
    return box(x1, y1, x2, y2)


def pad_square(b: Column, pct: float) -> Column:
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    half = side / 2 + F.bround(side * pct)
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return box(cx - half, cy - half, cx + half, cy + half)


def crop_box(b: Column, pad: float, w: Column, h: Column) -> Column:
    """Padded by a share of each side, cut to whole pixels and to the image; null if nothing is left."""
    px, py = (b["x2"] - b["x1"]) * pad, (b["y2"] - b["y1"]) * pad
    x1, y1 = F.greatest((b["x1"] - px).cast("int"), F.lit(0)), F.greatest((b["y1"] - py).cast("int"), F.lit(0))
    x2, y2 = F.least((b["x2"] + px).cast("int"), w.cast("int")), F.least((b["y2"] + py).cast("int"), h.cast("int"))
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def axis_iou(a: Column, b: Column, axis: str) -> Column:
    low, high = f"{axis}1", f"{axis}2"
    shared = F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))
    union = F.greatest(a[high], b[high]) - F.least(a[low], b[low])
    return F.when(union > 0, shared / union).otherwise(0.0)


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def is_candidate(b: Column, w: Column, h: Column, min_area=30.0, max_share=0.5, min_side=3.0, aspect=(0.1, 10.0)) -> Column:
    bw, bh = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return (area(b) >= min_area) & (area(b) <= w * h * max_share) & (bw >= min_side) & (bh >= min_side) & (bw / bh).between(*aspect)
