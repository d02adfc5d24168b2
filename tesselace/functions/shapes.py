"""Points, segments and triangles as column expressions. A point is a list of columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = list[Column]


def minus(a: Point, b: Point) -> Point:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: Point, b: Point) -> Column:
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def triangle_products(p: Point, a: Point, b: Point, c: Point) -> list[Column]:
    """Products of the sides ab and ac with the ways from a, b and c to p: d1 to d6 of the closest-point test."""
    ab, ac = minus(b, a), minus(c, a)
    return [dot(side, minus(p, corner)) for corner in (a, b, c) for side in (ab, ac)]


def triangle_weights(d: list[Column]) -> tuple[Column, Column]:
    """Weights (of b and of c) of the point of a triangle that is closest, by the region of the corner, side or inside
    that it falls into. d: columns of triangle_products. A triangle without area counts as its sides."""
    d1, d2, d3, d4, d5, d6 = d
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    whole = va + vb + vc
    zero, one = F.lit(0.0), F.lit(1.0)
    on_ab, on_ac, on_bc = ratio(d1, d1 - d3), ratio(d2, d2 - d6), ratio(d4 - d3, (d4 - d3) + (d5 - d6))
    regions = [
        ((d1 <= 0) & (d2 <= 0), zero, zero),
        ((d3 >= 0) & (d4 <= d3), one, zero),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), on_ab, zero),
        ((d6 >= 0) & (d5 <= d6), zero, one),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, on_ac),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), one - on_bc, on_bc),
    ]

    def pick(k: int, inside: Column) -> Column:
        out = F.when(regions[0][0], regions[0][k])
        for r in regions[1:]:
            out = out.when(r[0], r[k])
        return out.otherwise(inside)

    return pick(1, ratio(vb, whole)), pick(2, ratio(vc, whole))


def at_weights(a: Point, b: Point, c: Point, v: Column, w: Column) -> Point:
    return [x + v * (y - x) + w * (z - x) for x, y, z in zip(a, b, c, strict=True)]


def segment_distance2(p: Point, a: Point, b: Point) -> Column:
    """Squared distance of a point from a segment."""
    ab, ap = minus(b, a), minus(p, a)
    t = F.least(F.greatest(ratio(dot(ab, ap), dot(ab, ab)), F.lit(0.0)), F.lit(1.0))
    away = [x - t * y for x, y in zip(ap, ab, strict=True)]
    return dot(away, away)


def cross2(a: Point, b: Point) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def flat_triangle_distance2(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Squared distance of a point from a triangle of the plane: 0 inside or on a side, of either orientation."""
    turns = [cross2(minus(y, x), minus(p, x)) for x, y in ((a, b), (b, c), (c, a))]
    area = cross2(minus(b, a), minus(c, a))
    inside = (area != 0) & (((turns[0] >= 0) & (turns[1] >= 0) & (turns[2] >= 0)) | ((turns[0] <= 0) & (turns[1] <= 0) & (turns[2] <= 0)))
    return F.when(inside, F.lit(0.0)).otherwise(F.least(*(segment_distance2(p, x, y) for x, y in ((a, b), (b, c), (c, a)))))


def crossing(a: Point, u: Point, b: Point, v: Point) -> Column:
    """Parameter t at which the line a + t u of the plane meets the line b + s v; null where they are parallel."""
    return F.try_divide(cross2(minus(b, a), v).cast("double"), cross2(u, v).cast("double"))


def border_crossings(a: Point, u: Point, width: float, height: float) -> Column:
    """Sorted parameters at which the line a + t u meets the border of an image (0..width, 0..height); two or none."""
    hits = []
    for k, size, other in ((0, width, height), (1, height, width)):
        for edge in (0.0, float(size)):
            t = F.try_divide((F.lit(edge) - a[k]).cast("double"), u[k].cast("double"))
            there = a[1 - k] + t * u[1 - k]
            hits.append(F.when((there >= 0) & (there <= other), t))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    return F.when(F.size(found) >= 2, F.array(F.array_min(found), F.array_max(found))).otherwise(F.array().cast("array<double>"))


def between_lines(a: Point, u: Point, b: Point, v: Point) -> Point:
    """The middle of the shortest way between two lines of space; nulls where they are parallel."""
    w = minus(a, b)
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    low = uu * vv - uv * uv
    s, t = F.try_divide((uv * vw - vv * uw).cast("double"), low.cast("double")), F.try_divide((uu * vw - uv * uw).cast("double"), low.cast("double"))
    return [((x + s * i) + (y + t * j)) / 2 for x, i, y, j in zip(a, u, b, v, strict=True)]


def pixel_size(centre: list[float], side: list[float], point: Point, focal: float) -> Column:
    """Width, at a point, of one pixel of a camera: the distance from its centre over its focal length in pixels, seen
    along `side`, a unit vector across the view."""
    away = [x - F.lit(c) for x, c in zip(point, centre, strict=True)]
    across = dot(away, [F.lit(s) for s in side])
    return F.sqrt(dot(away, away) - across * across) / focal


def bilinear_weights(x: Column, y: Column, width: int, height: int) -> list[tuple[Column, Column, Column]]:
    """(column, row, weight) of the four cells around a place, the upper left one clamped into the image."""
    left, top = (F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 2)).cast("long") for v, n in ((x, width), (y, height)))
    fx, fy = x - left, y - top
    return [(left + i, top + j, (fx if i else 1 - fx) * (fy if j else 1 - fy)) for j in (0, 1) for i in (0, 1)]


def gaussian(x: Column, sigma: float) -> Column:
    """exp(-x^2 / (2 sigma^2)) as a power of two, as single-precision code computes it."""
    return F.pow(F.lit(2.0), -(x * x) / (2 * sigma * sigma) * 1.4426950408889634)


def local_metres(latitude: Column, longitude: Column, mean_latitude: float) -> tuple[Column, Column]:
    """East and north of the origin in metres, on a sphere flattened at a mean latitude (all in degrees)."""
    import math

    metre = 6378137.0 * math.pi / 180
    return longitude * (metre * math.cos(math.radians(mean_latitude))), latitude * metre


def earth_fixed(latitude: Column, longitude: Column, altitude: Column) -> Point:
    """Cartesian coordinates of a place on the WGS84 ellipsoid; a missing altitude counts as 0."""
    flat = 1 / 298.257223563
    e2 = flat * (2 - flat)
    lat, lon, alt = F.radians(latitude), F.radians(longitude), F.coalesce(altitude, F.lit(0.0))
    n = 6378137.0 / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [(n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + alt) * F.sin(lat)]


def _bits(x: pd.Series) -> pd.Series:
    v = x.to_numpy(np.float64, na_value=np.nan)
    return pd.Series((v + 0.0).view(np.int64)).astype("Int64").mask(~(v >= 0))


def bit_key(x: Column | str) -> Column:
    """An integer that orders non-negative doubles as they are (their bits); null for negative ones and no numbers."""
    return F.pandas_udf(_bits, "long")(x)
