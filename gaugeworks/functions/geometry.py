"""Rings of map shapes as arrays of points (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simplified(points: Column, digits: int = 4, least: int = 4) -> Column:
    """Points rounded, without those equal to the point before; null where fewer than ``least`` remain."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    once = F.filter(rounded, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(rounded, i - 1)))
    return F.when(F.size(once) >= least, once)


def centroid(points: Column, digits: int = 5) -> Column:
    """Mean of the vertices (x, y); null without points."""

    def mean(field: str) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p[field])
        return F.round(total / F.nullif(F.size(points), F.lit(0)), digits)

    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))
