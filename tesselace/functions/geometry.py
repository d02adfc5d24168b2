"""Scalar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def projected(p: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a point under a 3 x 4 camera (row-major); (-1, -1) at or behind the camera."""
    row = lambda k: p[4 * k] * x + p[4 * k + 1] * y + p[4 * k + 2] * z + F.lit(p[4 * k + 3])
    depth = row(2)
    at = lambda k: F.when(depth <= 0, F.lit(-1.0)).otherwise(row(k) / depth)
    return at(0), at(1)


def pixel(v: Column) -> Column:
    """Nearest whole pixel; halves go up."""
    return F.floor(v + 0.5)


def back_projected(inverse: list[float], centre: list[float], u: Column, v: Column, depth: Column) -> list[Column]:
    """The point at `depth` along the ray of a pixel; inverse: the camera's 3 x 3 inverse (row-major)."""
    ray = [inverse[3 * k] * u + inverse[3 * k + 1] * v + F.lit(inverse[3 * k + 2]) for k in range(3)]
    size = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1] + ray[2] * ray[2])
    return [F.lit(c) + r / size * depth for c, r in zip(centre, ray, strict=True)]


def valid_depth(d: Column) -> Column:
    """Positive and a number."""
    return F.coalesce((d > 0) & ~F.isnan(d), F.lit(False))


def angle_degrees(dot: Column) -> Column:
    """Of two unit vectors; 0 where rounding takes the product out of range."""
    return F.nanvl(F.degrees(F.acos(dot)), F.lit(0.0))


def face_weight(cos_a: Column, cos_b: Column) -> Column:
    """1 - min(cos a, cos b); 1 where that is no number or not in 0..1."""
    w = 1 - F.least(cos_a, cos_b)
    return F.when(F.isnan(w) | (w < 0) | (w > 1), 1.0).otherwise(w)


def relative_error(test: Column, reference: Column) -> Column:
    return F.abs(test - reference) / F.greatest(F.abs(reference), F.lit(1e-6))


def task_seed(seed: int, kind: str, key: Column, turn: int = 0) -> Column:
    """A seed that depends on the task's key, not on where or when it runs."""
    return F.xxhash64(F.lit(seed), F.lit(kind), key, F.lit(turn))


def lanczos3(x: Column) -> Column:
    a = x * math.pi
    return F.when(x == 0, 1.0).when(F.abs(x) >= 3, 0.0).otherwise(3 * F.sin(a) * F.sin(a / 3) / (a * a))


def lanczos_taps(source: int, target: int) -> list[list[tuple[int, float]]]:
    """For each target cell its (source cell, weight) taps: normalised, clamped at the ends, zero taps left out."""
    scale = source / target
    reach = 3 * max(1.0, scale)
    out = []
    for t in range(target):
        centre = (t + 0.5) * scale - 0.5
        taps: dict[int, float] = {}
        for s in range(math.ceil(centre - reach), math.floor(centre + reach) + 1):
            d = (s - centre) / max(1.0, scale)
            w = 1.0 if d == 0 else 0.0 if abs(d) >= 3 else 3 * math.sin(math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * d) ** 2
            if w:
                k = min(max(s, 0), source - 1)
                taps[k] = taps.get(k, 0.0) + w
        total = sum(taps.values())
        out.append([(k, w / total) for k, w in sorted(taps.items()) if w])
    return out
