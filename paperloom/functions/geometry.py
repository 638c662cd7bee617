"""Box arithmetic as column expressions; everything stays in generated code.

A box is four columns or expressions x0, y0, x1, y1 with y growing downwards.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Box:
    """The box in columns `names`, of the table alias `prefix` if one is given."""
    return Box(*(F.col(f"{prefix}.{n}" if prefix else n) for n in names))


def width(b: Box) -> Column:
    return b.x1 - b.x0


def height(b: Box) -> Column:
    return b.y1 - b.y0


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def hull(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def overlap_area(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return F.greatest(width(i), F.lit(0.0)) * F.greatest(height(i), F.lit(0.0))


def touches(a: Box, b: Box) -> Column:
    """Whether the boxes share more than a point; a shared edge is enough."""
    i = intersection(a, b)
    return (width(i) >= 0) & (height(i) >= 0) & (width(i) + height(i) > 0)


def contains(outer: Box, inner: Box) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes without area."""
    i = overlap_area(a, b)
    return F.coalesce(F.try_divide(i, area(a) + area(b) - i), F.lit(0.0))


def share_of(part: Box, whole: Box) -> Column:
    """Intersection over the area of `whole`; 0 if that is empty."""
    return F.coalesce(F.try_divide(overlap_area(part, whole), area(whole)), F.lit(0.0))


def hull_iou(a: Box, b: Box) -> Column:
    """Intersection over the area of the common hull."""
    return F.coalesce(F.try_divide(overlap_area(a, b), area(hull(a, b))), F.lit(0.0))


def iou_variants(a: Box, b: Box, eps: float = 1e-7) -> tuple[Column, Column, Column]:
    """Generalised, distance and complete IoU; eps keeps empty boxes from dividing by 0."""
    h = hull(a, b)
    wa, ha, wb, hb = width(a), height(a) + eps, width(b), height(b) + eps
    i = overlap_area(a, b)
    union = wa * ha + wb * hb - i + eps
    own = i / union
    around = width(h) * height(h) + eps
    apart = (F.pow(b.x0 + b.x1 - a.x0 - a.x1, 2) + F.pow(b.y0 + b.y1 - a.y0 - a.y1, 2)) / 4
    off = apart / (F.pow(width(h), 2) + F.pow(height(h), 2) + eps)
    v = 4 / F.pow(F.pi(), 2) * F.pow(F.atan(wb / hb) - F.atan(wa / ha), 2)
    return own - (around - union) / around, own - off, own - (off + v * v / (v - own + 1 + eps))


def resampled(points: Column, n: int) -> Column:
    """n values along a list of values, by linear interpolation at equal steps."""
    last = F.size(points) - 1

    def at(k):
        x = k * last / (n - 1)
        lo = F.least(F.floor(x).cast("int"), F.greatest(last - 1, F.lit(0)))
        a, b = F.get(points, lo), F.coalesce(F.get(points, lo + 1), F.get(points, lo))
        return a + (b - a) * (x - lo)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Signed overlap of two intervals over their hull's length; a gap counts as negative."""
    return (F.least(a1, b1) - F.greatest(a0, b0)) / (F.greatest(a1, b1) - F.least(a0, b0) + F.lit(1e-9))


def side_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the shorter one's length, which counts as 1 at least."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def relation(a0: Column, a1: Column, b0: Column, b1: Column, near: float = 0.0) -> Column:
    """How interval a lies to interval b: before, after, near, contains, inside, overlaps."""
    return F.when(a1 < b0 - near, "before").when(a0 > b1 + near, "after").when((a1 <= b0) | (a0 >= b1), "near").when((a0 <= b0) & (a1 >= b1), "contains").when((a0 >= b0) & (a1 <= b1), "inside").otherwise("overlaps")


def clip(b: Box, to: Box) -> Box:
    return Box(*(F.greatest(lo, F.least(v, hi)) for v, lo, hi in ((b.x0, to.x0, to.x1), (b.y0, to.y0, to.y1), (b.x1, to.x0, to.x1), (b.y1, to.y0, to.y1))))


def moved(b: Box, dx, dy) -> Box:
    return Box(b.x0 + dx, b.y0 + dy, b.x1 + dx, b.y1 + dy)


def scaled(b: Box, sx, sy) -> Box:
    return Box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def grown(b: Box, by) -> Box:
    return Box(b.x0 - by, b.y0 - by, b.x1 + by, b.y1 + by)


def normalised(b: Box, page_width, page_height, digits: int = 3) -> Box:
    """Fractions of the page, y counted from the bottom, rounded half to even."""
    f = lambda v, of: F.bround(v / of, digits)
    return Box(f(b.x0, page_width), f(page_height - b.y1, page_height), f(b.x1, page_width), f(page_height - b.y0, page_height))


def denormalised(b: Box, page_width, page_height) -> Box:
    """Whole page units, y counted from the top, cut towards zero."""
    f = lambda v, of: (v * of).cast("int")
    return Box(f(b.x0, page_width), f(1 - b.y1, page_height), f(b.x1, page_width), f(1 - b.y0, page_height))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_centre(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, width(b), height(b)


def rotated(x: Column, y: Column, cx, cy, degrees) -> tuple[Column, Column]:
    """The point turned about a centre."""
    r = F.radians(degrees)
    return cx + (x - cx) * F.cos(r) - (y - cy) * F.sin(r), cy + (x - cx) * F.sin(r) + (y - cy) * F.cos(r)


def rotated_box(b: Box, cx, cy, degrees) -> Box:
    """The box around the four turned corners."""
    corners = [rotated(x, y, cx, cy, degrees) for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    xs, ys = zip(*corners)
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def ordered_corners(points: Column) -> Column:
    """Four points (structs x, y) from the upper left one clockwise: by least and largest sums and differences of their coordinates; ties go to the first."""
    at = lambda key: F.array_min(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    chosen = [at(k) for k in (lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"], lambda p: -p["x"] - p["y"], lambda p: p["x"] - p["y"])]
    return F.array(*[F.struct(c["x"].alias("x"), c["y"].alias("y")) for c in chosen])


def polygon_box(points: Column) -> Box:
    """Bounding box of an array of structs x, y."""
    return Box(F.array_min(points["x"]), F.array_min(points["y"]), F.array_max(points["x"]), F.array_max(points["y"]))


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon from its corners in order."""
    turn = lambda p, i: p["x"] * points[(i + 1) % F.size(points)]["y"] - points[(i + 1) % F.size(points)]["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(points, turn), F.lit(0.0), lambda s, v: s + v)) / 2


def as_struct(b: Box) -> Column:
    return F.struct(b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"))
