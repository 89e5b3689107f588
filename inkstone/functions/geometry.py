"""Box and quad measures as column expressions.

Boxes are four columns named x1, y1, x2, y2; quads are array<struct<x,y>> of 4.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; keeps nested measures from being substituted over and over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(col: Column) -> Column:
    """Round half towards plus infinity; Spark's round goes away from zero."""
    return F.floor(col + F.lit(0.5))


def upper_median(column: str) -> Column:
    """Upper middle of the sorted values: a mergeable count table, no collected list."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def intersection(p: str = "a_", q: str = "b_") -> Column:
    ix = F.least(F.col(f"{p}x2"), F.col(f"{q}x2")) - F.greatest(F.col(f"{p}x1"), F.col(f"{q}x1"))
    iy = F.least(F.col(f"{p}y2"), F.col(f"{q}y2")) - F.greatest(F.col(f"{p}y1"), F.col(f"{q}y1"))
    return F.greatest(ix, F.lit(0)) * F.greatest(iy, F.lit(0))


def box_iou(p: str = "a_", q: str = "b_") -> Column:
    inter = intersection(p, q)
    union = box_area(p) + box_area(q) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def box_overlap_smaller(p: str = "a_", q: str = "b_") -> Column:
    small = F.least(box_area(p), box_area(q))
    return F.when(small > 0, intersection(p, q) / small).otherwise(F.lit(0.0))


def struct_iou(a: Column, b: Column) -> Column:
    """The same measure between two structs with x1, y1, x2, y2 fields."""
    ix = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    iy = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    inter = ix * iy
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def struct_overlap_smaller(a: Column, b: Column, floor_area: float = 0.0) -> Column:
    ix = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    iy = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    area_a = F.greatest(F.lit(floor_area), (a.x2 - a.x1) * (a.y2 - a.y1))
    area_b = F.greatest(F.lit(floor_area), (b.x2 - b.x1) * (b.y2 - b.y1))
    small = F.least(area_a, area_b)
    return F.when(small > 0, ix * iy / small).otherwise(F.lit(0.0))


def quad_of_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def _at(pts: Column, i: int) -> Column:
    return F.get(pts, F.lit(i % 4))


def edge_lengths(pts: Column) -> Column:
    return F.array(
        *[F.hypot(_at(pts, i + 1).x - _at(pts, i).x, _at(pts, i + 1).y - _at(pts, i).y) for i in range(4)]
    )


def corner(pts: Column, index: Column) -> Column:
    return F.get(pts, F.pmod(index, F.lit(4)).cast("int"))


def quad_angle(pts: Column, edge: Column) -> Column:
    a, b = corner(pts, edge), corner(pts, edge + 1)
    return F.degrees(F.atan2(b.y - a.y, b.x - a.x))


def axis_angle(angle: Column) -> Column:
    """Fold an edge angle into [-90, 90)."""
    return F.pmod(angle + 90, F.lit(180.0)) - 90


def turned_box(pts: Column, c: Column, s: Column) -> Column:
    """Upright box of the quad after a turn whose cosine and sine are given."""
    xs = F.transform(pts, lambda p: p.x * c + p.y * s)
    ys = F.transform(pts, lambda p: -p.x * s + p.y * c)
    return F.struct(
        F.array_min(xs).alias("x1"),
        F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"),
        F.array_max(ys).alias("y2"),
    )


def frame_box(pts: Column, degrees: Column) -> Column:
    """Upright box of the quad after turning it into the text frame."""
    return turned_box(pts, F.cos(F.radians(degrees)), F.sin(F.radians(degrees)))


def is_tall(p: str = "") -> Column:
    """Column-shaped box: height above 1.3 widths."""
    return (F.col(f"{p}y2") - F.col(f"{p}y1")) > (F.col(f"{p}x2") - F.col(f"{p}x1")) * 1.3
