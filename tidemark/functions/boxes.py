"""Column expressions over boxes: corners (x1, y1, x2, y2) unless named by origin and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection_area(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    both = intersection_area(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def clamp(b: Box, width: Column, height: Column) -> Box:
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    return hold(b[0], width), hold(b[1], height), hold(b[2], width), hold(b[3], height)


def status(b: Box, width: Column, height: Column) -> Column:
    """ABSENT for a null corner, INVALID without extent inside the frame, else OK."""
    absent = b[0].isNull() | b[1].isNull() | b[2].isNull() | b[3].isNull()
    c = clamp(b, width, height)
    return F.when(absent, "ABSENT").when((c[2] <= c[0]) | (c[3] <= c[1]), "INVALID").otherwise("OK")


def overflow(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """How far the box is out of the frame on each side: left, top, right, bottom."""
    over = lambda v: F.greatest(v, F.lit(0.0))
    return over(-b[0]), over(-b[1]), over(b[2] - width), over(b[3] - height)


def visible_fraction(subject: Box, crop: Box) -> Column:
    own = area(subject)
    return F.when(own > 0, intersection_area(subject, crop) / own)


def inside(x: Column, y: Column, crop: Box) -> Column:
    """Half-open: the right and bottom edges are outside."""
    return (x >= crop[0]) & (x < crop[2]) & (y >= crop[1]) & (y < crop[3])


def crop_size(width: Column, height: Column, tw: int, th: int) -> tuple[Column, Column]:
    """Width and height of the largest crop of ratio tw:th in whole pixels."""
    wide = width * th >= height * tw
    w = F.when(wide, F.call_function("div", height * tw, F.lit(th))).otherwise(width)
    h = F.when(wide, height).otherwise(F.call_function("div", width * th, F.lit(tw)))
    return w.cast("bigint"), h.cast("bigint")


def crop_at(width: Column, height: Column, tw: int, th: int, cx: Column, cy: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) of that crop centred at a point as far as the frame allows."""
    w, h = crop_size(width, height, tw, th)
    place = lambda c, size, most: F.least(F.greatest(F.floor(c - size / 2), F.lit(0)), most - size).cast("bigint")
    return place(cx, w, width), place(cy, h, height), w, h


def focus_window(b: Box, margin: float) -> Box:
    """Box in shares of the frame widened by ``margin`` of its size on each side; the whole frame where the box is null or empty."""
    ok = F.coalesce((b[2] > b[0]) & (b[3] > b[1]), F.lit(False))
    dx, dy = (b[2] - b[0]) * margin, (b[3] - b[1]) * margin
    out = (F.greatest(b[0] - dx, F.lit(0.0)), F.greatest(b[1] - dy, F.lit(0.0)), F.least(b[2] + dx, F.lit(1.0)), F.least(b[3] + dy, F.lit(1.0)))
    return tuple(F.when(ok, v).otherwise(F.lit(whole)) for v, whole in zip(out, (0.0, 0.0, 1.0, 1.0), strict=True))


def stratum(offset: Column, near: float, strong: float) -> Column:
    return F.when(offset < near, "near_center").when(offset < strong, "off_center").otherwise("strongly_off_center")


def containing_placements(extent: Column, crop: Column, point: Column) -> tuple[Column, Column]:
    """Least and greatest whole offset at which a half-open crop lies in the frame and holds the point."""
    return F.greatest(F.floor(point - crop) + 1, F.lit(0)).cast("bigint"), F.least(F.floor(extent - crop), F.floor(point)).cast("bigint")


def best_placements(extent: Column, crop: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Least and greatest whole offset at which the crop overlaps [start, end) most, and that overlap; all offsets where none overlaps.

    The overlap grows, stays and falls with the offset: its plateau is clipped to the frame, and where the plateau holds
    no whole number one of its two neighbours is best.
    """
    legal = F.floor(extent - crop)
    overlap = lambda q: F.greatest(F.least(q + crop, end) - F.greatest(q.cast("double"), start), F.lit(0.0))
    hold = lambda q: F.least(F.greatest(q, F.lit(0)), legal)
    low, high = F.least(end - crop, start), F.greatest(end - crop, start)
    low, high = F.when(low > legal, legal).otherwise(F.greatest(low, F.lit(0.0))), F.when(low > legal, legal).otherwise(F.least(high, legal.cast("double")))
    first, last = F.ceil(low), F.floor(high)
    a, b = hold(F.floor(low)), hold(F.ceil(high))
    most = F.when(first <= last, overlap(first)).otherwise(F.greatest(overlap(a), overlap(b)))
    least = F.when(most == 0, F.lit(0)).when(first <= last, first).when(overlap(a) >= overlap(b), a).otherwise(b)
    top = F.when(most == 0, legal).when(first <= last, last).when(overlap(b) >= overlap(a), b).otherwise(a)
    return least.cast("bigint"), top.cast("bigint"), most


def canonical_center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """The centre from which ``crop_at`` gives this placement again."""
    return x + w / 2, y + h / 2


def crop_shift(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Distance of the crop's centre from the frame's, in shares of the frame."""
    return F.abs(x + w / 2 - width / 2) / width, F.abs(y + h / 2 - height / 2) / height


def context_retention(b: Box) -> Column:
    """Share of the frame that a focus window keeps."""
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))
