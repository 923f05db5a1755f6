"""Column expressions over half-open intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 where there is none."""
    overlap = F.least(e1, e2) - F.greatest(s1, s2)
    return F.greatest(overlap, overlap * 0)


def union(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e1 - s1) + (e2 - s2) - intersection(s1, e1, s2, e2)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal intersection over union; null where both are empty."""
    whole = union(s1, e1, s2, e2)
    return F.when(whole > 0, intersection(s1, e1, s2, e2) / whole)


def ceil_div(a: Column, b: Column | int) -> Column:
    """Exact ceiling of an integer quotient, b > 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return -floor_div(-a, b)


def floor_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def chunk_count(duration: Column, size: int, overlap: int) -> Column:
    """Number of sliding windows that reach the end: 1 up to ``size``, else ceil((d - size) / (size - overlap)) + 1."""
    return F.when(duration <= size, F.lit(1)).otherwise(ceil_div(duration - size, size - overlap) + 1).cast("bigint")


def first_frame(start: Column, num: int, den: int) -> Column:
    """First frame at or after ``start`` at num/den frames a unit, in whole numbers: no float boundary is off by one."""
    return ceil_div(start * num, den)


def last_frame(end: Column, num: int, den: int) -> Column:
    """Last frame before ``end``."""
    return ceil_div(end * num, den) - 1


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def precision_recall(both: Column, predicted: Column, reference: Column) -> tuple[Column, Column, Column, Column]:
    """Precision, recall, F1 and IoU of durations or counts; all 1 where both sides are empty, 0 where one is."""
    none = (predicted == 0) & (reference == 0)
    part = lambda total: F.when(none, 1.0).when(total > 0, both / total).otherwise(0.0)
    p, r = part(predicted), part(reference)
    return p, r, F.when(none, 1.0).otherwise(f1(p, r)), part(predicted + reference - both)
