"""Vectors as array columns: everything here stays in the JVM. Sums run in index order, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, epsilon: float = EPSILON) -> Column:
    """v / (|v| + epsilon); the zero vector stays zero."""
    # Bound by a lambda, the norm is computed once a row and not once a component.
    return F.get(F.transform(F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / (s["n"] + F.lit(epsilon)))), F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def chord(similarity: Column) -> Column:
    """The Euclidean distance of unit vectors with this dot product."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * similarity))


def status(v: Column, size: int) -> Column:
    """ok, or why a vector can't be used: size, not_finite, zero."""
    fine = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNull() | (F.size(v) != size), "size").when(~fine, "not_finite").when(norm(v) == 0, "zero").otherwise("ok")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes with x1, y1, x2, y2; 0 without a common area."""
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(both <= 0, F.lit(0.0)).otherwise(both / (area(a) + area(b) - both + F.lit(1e-9)))


def box_size(box: Column) -> Column:
    return F.least(box["x2"] - box["x1"], box["y2"] - box["y1"])


def clamped(box: Column, width: Column, height: Column) -> Column:
    """Whole-number corners inside the frame, null without an area. Coordinates are cut towards zero."""
    x1, y1 = F.greatest(box["x1"].cast("int"), F.lit(0)), F.greatest(box["y1"].cast("int"), F.lit(0))
    x2, y2 = F.least(box["x2"].cast("int"), width), F.least(box["y2"].cast("int"), height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def yaw_asymmetry(landmarks: Column) -> Column:
    """The larger over the smaller horizontal gap between an eye (points 1, 2) and the nose (3); infinite below 0.001."""
    left, right = F.abs(F.get(landmarks, F.lit(2))["x"] - F.get(landmarks, F.lit(0))["x"]), F.abs(F.get(landmarks, F.lit(1))["x"] - F.get(landmarks, F.lit(2))["x"])
    low, high = F.least(left, right), F.greatest(left, right)
    return F.when(low < 1e-3, F.lit(float("inf"))).otherwise(high / low)


def change_fraction(a: Column, b: Column, delta: float = 12.0) -> Column:
    """The share of positions whose values differ by more than ``delta``."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > F.lit(delta))) / F.size(a)
