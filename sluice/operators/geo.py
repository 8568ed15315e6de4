"""Points, boxes and distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between points in degrees."""
    c = lambda x: F.radians(F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)))
    a = F.pow(F.sin((c(lat2) - c(lat1)) / 2), 2) + F.cos(c(lat1)) * F.cos(c(lat2)) * F.pow(F.sin((c(lon2) - c(lon1)) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box_of(lat: float, lon: float, radius: float) -> tuple[float, float, float, float]:
    """(least latitude, greatest, least longitude, greatest) around a circle."""
    import math

    d = math.degrees(radius / EARTH_M)
    e = d / max(math.cos(math.radians(lat)), 1e-9)
    return lat - d, lat + d, lon - e, lon + e


def within(df: DataFrame, lat: str, lon: str, centre: tuple[float, float], radius: float) -> DataFrame:
    """Rows in the circle: first by its box, which a scan can prune, then by distance."""
    a, b, c, d = box_of(*centre, radius)
    boxed = df.where(F.col(lat).between(a, b))
    boxed = boxed.where(F.col(lon).between(c, d)) if -180 <= c and d <= 180 else boxed
    return boxed.where(haversine(lat, lon, *centre) <= radius)


def intersects(mins: list[str], maxs: list[str], low: list[float], high: list[float]) -> Column:
    """Whether boxes of any dimension meet the given one."""
    out = F.lit(True)
    for lo, hi, a, b in zip(mins, maxs, low, high):
        out = out & (F.col(lo) <= b) & (F.col(hi) >= a)
    return out


def box_join(left: DataFrame, right: DataFrame, cell: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pairs of boxes (columns <d>0 and <d>1 of each dimension) that meet, by the grid cells they lie in.

    Each pair is kept in one cell, the least they share, so none comes twice.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        for d in dims:
            lo, hi = F.floor(F.col(f"{side}_{d}0") / cell), F.floor(F.col(f"{side}_{d}1") / cell)
            out = out.withColumn(f"_{d}", F.explode(F.sequence(lo, hi)))
        return out

    j = cells(left, "l").join(cells(right, "r"), [f"_{d}" for d in dims])
    for d in dims:
        first = F.floor(F.greatest(F.col(f"l_{d}0"), F.col(f"r_{d}0")) / cell)
        j = j.where((F.col(f"l_{d}0") <= F.col(f"r_{d}1")) & (F.col(f"r_{d}0") <= F.col(f"l_{d}1")) & (F.col(f"_{d}") == first))
    return j.drop(*[f"_{d}" for d in dims])
