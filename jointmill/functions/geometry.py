"""Boxes and polygons held as array<array<double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jointmill.functions.paths import col


def _axis(points: Column, i: int) -> Column:
    return F.transform(F.filter(points, lambda p: F.size(p) > i), lambda p: p[i])


def bbox(points: Column | str) -> Column:
    """Struct x0, y0, x1, y1; all null for an empty or null polygon."""
    p = col(points)
    return F.struct(
        F.array_min(_axis(p, 0)).alias("x0"), F.array_min(_axis(p, 1)).alias("y0"),
        F.array_max(_axis(p, 0)).alias("x1"), F.array_max(_axis(p, 1)).alias("y1"),
    )


def bbox_center_x(points: Column | str) -> Column:
    """Middle of the smallest and largest x; null without points."""
    xs = _axis(col(points), 0)
    return (F.array_min(xs) + F.array_max(xs)) / 2


def vertex_mean_x(points: Column | str) -> Column:
    """Mean x of the vertices, 0.0 without any."""
    xs = _axis(col(points), 0)
    n = F.size(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def polygon_area(points: Column | str) -> Column:
    """Shoelace area, 0.0 below three points."""
    p = col(points)
    n = F.size(p)
    cross = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0.0),
        lambda a, i: a + F.get(F.get(p, i), F.lit(0)) * F.get(F.get(p, (i + 1) % F.greatest(n, F.lit(1))), F.lit(1))
        - F.get(F.get(p, (i + 1) % F.greatest(n, F.lit(1))), F.lit(0)) * F.get(F.get(p, i), F.lit(1)),
    )
    return F.when(n >= 3, F.abs(cross) / 2).otherwise(F.lit(0.0))


def int_points(points: Column | str) -> Column:
    """Vertices on whole pixels, halves to the even one, as outlines are drawn."""
    return F.transform(col(points), lambda p: F.transform(p, lambda x: F.bround(x, 0).cast("int")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corner points from the top left, clockwise."""
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def clamped_box(box: Column, tolerance: float, width: Column, height: Column) -> Column:
    """Box grown on all sides by tolerance × its longer side, rounded outwards and clamped to the frame."""
    m = F.lit(float(tolerance)) * F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    return F.struct(
        F.greatest(F.lit(0), F.floor(box["x0"] - m)).alias("x0"), F.greatest(F.lit(0), F.floor(box["y0"] - m)).alias("y0"),
        F.least(width, F.ceil(box["x1"] + m)).alias("x1"), F.least(height, F.ceil(box["y1"] + m)).alias("y1"),
    )


def expanded(box: Column, margin: float) -> Column:
    """Box grown on each axis by margin × its extent there."""
    mx, my = (box["x1"] - box["x0"]) * F.lit(float(margin)), (box["y1"] - box["y0"]) * F.lit(float(margin))
    return F.struct((box["x0"] - mx).alias("x0"), (box["y0"] - my).alias("y0"), (box["x1"] + mx).alias("x1"), (box["y1"] + my).alias("y1"))


def squared(box: Column) -> Column:
    """Box whose shorter side is grown around its centre to the longer."""
    half = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"]) / 2
    cx, cy = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    wide = (box["x1"] - box["x0"]) >= (box["y1"] - box["y0"])
    return F.struct(
        F.when(wide, box["x0"]).otherwise(cx - half).alias("x0"), F.when(wide, cy - half).otherwise(box["y0"]).alias("y0"),
        F.when(wide, box["x1"]).otherwise(cx + half).alias("x1"), F.when(wide, cy + half).otherwise(box["y1"]).alias("y1"),
    )


def fitted(box: Column, width: Column, height: Column) -> Column:
    """Square on whole pixels around the box, shifted into the frame; clipped only where larger than the frame."""
    x0, y0 = F.floor(box["x0"]), F.floor(box["y0"])
    side = F.greatest(F.ceil(box["x1"]) - x0, F.ceil(box["y1"]) - y0)
    w, h = F.least(side, width), F.least(side, height)
    left = F.greatest(F.lit(0), F.least(x0, width - w))
    top = F.greatest(F.lit(0), F.least(y0, height - h))
    return F.struct(left.alias("x0"), top.alias("y0"), (left + w).alias("x1"), (top + h).alias("y1"))


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once: nested plain expressions would repeat it at every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def square_crop(box: Column, margin: float, width: Column, height: Column) -> Column:
    """Training crop: expand, square, fit."""
    return bound(box, lambda b: bound(squared(expanded(b, margin)), lambda s: fitted(s, width, height)))
