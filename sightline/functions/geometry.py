"""Box geometry as column expressions; boxes are (x1, y1, x2, y2) in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def from_xywh(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Box:
    """Corner form of a COCO box."""
    return F.col(x), F.col(y), F.col(x) + F.col(w), F.col(y) + F.col(h)


def from_center(cx: str, cy: str, w: str, h: str) -> Box:
    """Corner form of a box given by its center."""
    return F.col(cx) - F.col(w) / 2, F.col(cy) - F.col(h) / 2, F.col(cx) + F.col(w) / 2, F.col(cy) + F.col(h) / 2


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    none = F.lit(0.0)
    return F.greatest(none, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(none, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def area_bucket(w: Column, h: Column, width: Column, height: Column, small: float, medium: float) -> Column:
    """small, medium or large by share of the image; a share on an edge goes up."""
    share = w * h / (width * height)
    return F.when(share < small, "small").when(share < medium, "medium").otherwise("large")


def is_invalid(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, tolerance: float) -> Column:
    """Without area, or beyond the image by more than the tolerance."""
    return (w <= 0) | (h <= 0) | (x < -tolerance) | (y < -tolerance) | (x + w > width + tolerance) | (y + h > height + tolerance)


def at_edge(b: Box, width: Column, height: Column, tolerance: float) -> Column:
    return (b[0] <= tolerance) | (b[1] <= tolerance) | (b[2] >= width - tolerance) | (b[3] >= height - tolerance)


def relative_side(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.sqrt(w * h / (width * height))


def inside(x: Column, y: Column, b: Box) -> Column:
    """Whether a point lies in a box, its border included."""
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def crop(b: Box, width: Column, height: Column, context: float, least: float) -> Column:
    """A square of ``context`` times the longer side, at least ``least`` wide, around the box and within the image."""
    side = F.greatest(context * F.greatest(b[2] - b[0], b[3] - b[1]), F.lit(float(least)))
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    low = lambda c: F.greatest(F.lit(0.0), c - side / 2)
    return F.struct(low(cx).alias("x1"), low(cy).alias("y1"), F.least(width, cx + side / 2).alias("x2"), F.least(height, cy + side / 2).alias("y2"))
