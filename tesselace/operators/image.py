"""Resampling of two-axis rasters with holes: rows (y, x, v) of whole numbers; sums and weights, one division at the end."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselace.operators.raster import path_costs

Taps = dict[int, int]


def plane_stencil(grid: DataFrame, taps_y: Taps, taps_x: Taps, stride: int = 1) -> DataFrame:
    """(y, x, total, weight): the weighted neighbourhood of each cell that exists, over the cells that exist; with a
    stride, of every stride-th cell, numbered anew.

    Each cell is sent to the cells that it contributes to, so there is one aggregation and no self-join."""
    pairs = lambda taps: F.array(*(F.struct(F.lit(-d).alias("d"), F.lit(w).alias("w")) for d, w in taps.items()))
    sent = grid.select("y", "x", "v", F.explode(pairs(taps_y)).alias("p")).select("*", F.explode(pairs(taps_x)).alias("q"))
    y, x, w = F.col("y") + F.col("p.d"), F.col("x") + F.col("q.d"), F.col("p.w") * F.col("q.w")
    own = (F.col("p.d") == 0) & (F.col("q.d") == 0)
    hit = sent.select(y.alias("y"), x.alias("x"), (F.col("v") * w).alias("part"), w.alias("w"), own.alias("own"))
    if stride > 1:
        at = lambda c: F.pmod(F.col(c), F.lit(stride)) == 0
        hit = hit.where(at("y") & at("x")).select(*(F.floor(F.col(c) / stride).cast("long").alias(c) for c in ("y", "x")), "part", "w", "own")
    sums = hit.groupBy("y", "x").agg(F.sum("part").cast("long").alias("total"), F.sum("w").cast("long").alias("weight"), F.max("own").alias("own"))
    return sums.where("own").drop("own")


def resampled(grid: DataFrame, taps_y: list[list[tuple[int, int]]], taps_x: list[list[tuple[int, int]]]) -> DataFrame:
    """(y, x, total, weight) of a raster resampled by tables of taps: for each target place of an axis its (source,
    weight) pairs. One axis after the other; the tables, of an image's width, are broadcast. Cells without any source
    that exists are left out; where weights cancel, weight is 0 and the value undefined."""
    spark = grid.sparkSession

    def table(taps, c: str) -> DataFrame:
        rows = [(s, t, w) for t, pairs in enumerate(taps) for s, w in pairs]
        return F.broadcast(spark.createDataFrame(rows, f"{c} long, to_{c} long, w long"))

    once = grid.join(table(taps_x, "x"), "x").groupBy("y", F.col("to_x").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    both = once.join(table(taps_y, "y"), "y").groupBy(F.col("to_y").alias("y"), "x")
    return both.agg(F.sum(F.col("total") * F.col("w")).cast("long").alias("total"), F.sum(F.col("weight") * F.col("w")).cast("long").alias("weight"))


def clamped_taps(source: int, target: int, factor: int, taps: Taps) -> list[list[tuple[int, int]]]:
    """For each target place the taps around its source place, clamped into the axis."""
    out = []
    for t in range(target):
        found: dict[int, int] = {}
        for d, w in taps.items():
            s = min(max(t * factor + d, 0), source - 1)
            found[s] = found.get(s, 0) + w
        out.append(sorted(found.items()))
    return out


def doubled_taps(source: int, target: int) -> list[list[tuple[int, int]]]:
    """Bilinear upsampling by two: three quarters of the nearer cell, a quarter of the next, clamped."""
    out = []
    for t in range(target):
        near, next_ = t // 2, t // 2 + (1 if t % 2 else -1)
        found: dict[int, int] = {}
        for s, w in ((near, 3), (next_, 1)):
            s = min(max(s, 0), source - 1)
            found[s] = found.get(s, 0) + w
        out.append(sorted(found.items()))
    return out


def whole_taps(taps: list[list[tuple[int, float]]], unit: int = 1 << 14) -> list[list[tuple[int, int]]]:
    """Taps in whole units; those that round to nothing are left out."""
    return [[(s, round(w * unit)) for s, w in pairs if round(w * unit)] for pairs in taps]


def remapped(image: DataFrame, places: DataFrame, unit: int, fill: int) -> DataFrame:
    """(ty, tx, total, weight) for each target (ty, tx, sy, sx; source places in 1/unit of a pixel, or null): the
    bilinear mean over the source pixels that exist; where their weight is at most a fifth, the nearest pixel; the
    filling where there is none or the place is null."""
    corner = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)))).alias("c")
    low = lambda c: F.floor(F.col(c) / unit).cast("long")
    part = lambda c, k: F.when(F.col(f"c.{k}") == 1, F.pmod(F.col(c), F.lit(unit))).otherwise(unit - F.pmod(F.col(c), F.lit(unit)))
    taps = places.where("sy is not null and sx is not null").select("ty", "tx", "sy", "sx", corner)
    taps = taps.select("ty", "tx", (low("sy") + F.col("c.j")).alias("y"), (low("sx") + F.col("c.i")).alias("x"), (part("sy", "j") * part("sx", "i")).alias("w"))
    best = F.max(F.struct("w", -F.col("y"), -F.col("x"), "v"))["v"]
    met = taps.join(image.select("y", "x", "v"), ["y", "x"]).groupBy("ty", "tx").agg(F.sum(F.col("w") * F.col("v")).alias("sum"), F.sum("w").alias("w"), best.alias("nearest"))
    enough = 5 * F.col("w") > unit * unit
    made = places.select("ty", "tx").join(met, ["ty", "tx"], "left")
    total = F.when(enough, F.col("sum")).when(F.col("nearest").isNotNull(), F.col("nearest")).otherwise(F.lit(fill))
    return made.select("ty", "tx", total.cast("long").alias("total"), F.when(enough, F.col("w")).otherwise(1).cast("long").alias("weight"))


def area_warped(image: DataFrame, boxes: DataFrame, unit: int, fill: int) -> DataFrame:
    """(ty, tx, total, weight) for each target (ty, tx, y0, y1, x0, x1: a source box in 1/unit of a pixel): the mean
    over the covered pixels by overlap where the box is wider than a pixel on both axes, else as remapped at its middle."""
    wide = (F.col("y1") - F.col("y0") > unit) & (F.col("x1") - F.col("x0") > unit)
    low, high = lambda c: F.floor(F.col(c) / unit).cast("long"), lambda c: F.floor((F.col(c) - 1) / unit).cast("long")
    over = lambda c: F.least(F.col(f"{c}1"), (F.col(c) + 1) * unit) - F.greatest(F.col(f"{c}0"), F.col(c) * unit)
    big = boxes.where(wide)
    cells = big.withColumn("y", F.explode(F.sequence(low("y0"), high("y1")))).withColumn("x", F.explode(F.sequence(low("x0"), high("x1"))))
    met = cells.select("ty", "tx", "y", "x", (over("y") * over("x")).alias("w")).join(image.select("y", "x", "v"), ["y", "x"])
    sums = met.groupBy("ty", "tx").agg(F.sum(F.col("w") * F.col("v")).cast("long").alias("total"), F.sum("w").cast("long").alias("weight"))
    filled = big.select("ty", "tx").join(sums, ["ty", "tx"], "left").select("ty", "tx", F.coalesce("total", F.lit(fill)).cast("long").alias("total"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    middle = lambda c: F.floor((F.col(f"{c}0") + F.col(f"{c}1") - unit) / 2).cast("long").alias(f"s{c}")
    return filled.unionByName(remapped(image, boxes.where(~wide).select("ty", "tx", middle("y"), middle("x")), unit, fill))


def path_means(grid: DataFrame, y: str, x: str, label: str, cost: str, p1: int, p2: int) -> DataFrame:
    """(y, x, label, total, n): path costs along both axes in both directions, added up, and their number."""
    turn = lambda c, other, way: path_costs(grid.select(F.col(c).alias("__row"), (way * F.col(other)).alias("__x"), label, cost), "__row", "__x", label, cost, p1, p2)
    parts = []
    for c, other in ((y, x), (x, y)):
        for way in (1, -1):
            parts.append(turn(c, other, way).select(F.col("__row").alias(c), (way * F.col("__x")).alias(other), label, "path_cost"))
    return reduce(DataFrame.unionByName, parts).groupBy(y, x, label).agg(F.sum("path_cost").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


def padded_plane(v: np.ndarray, filled: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and depths (0 for cells of their own, -k for the k-th copy, 1 for empty ones): in raster order an empty
    cell takes the value of its left or else its upper neighbour, then backwards of its right or else its lower one.

    Cells of one anti-diagonal do not depend on one another, so a sweep goes by diagonals."""
    v, depth = v.copy(), np.where(filled, 0, 1)
    rows, cols = v.shape
    for way in (1, -1):
        a, d = v[::way, ::way], depth[::way, ::way]
        for k in range(1, rows + cols - 1):
            i = np.arange(max(0, k - cols + 1), min(rows, k + 1))
            j = k - i
            for di, dj in ((0, 1), (1, 0)):
                use = (d[i, j] == 1) & (i >= di) & (j >= dj)
                si, sj = i[use] - di, j[use] - dj
                ok = (d[si, sj] <= 0) & (d[si, sj] > -most)
                ti, tj = i[use][ok], j[use][ok]
                a[ti, tj] = a[si[ok], sj[ok]]
                d[ti, tj] = d[si[ok], sj[ok]] - 1
    return v, depth


def padded(cells: DataFrame, atlas: str, height: int, width: int, most: int) -> DataFrame:
    """(atlas, y, x, v, depth) of all cells that have a value after padding. An atlas is one task's, of height * width."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v, filled = np.zeros((height, width), np.int64), np.zeros((height, width), bool)
        at = frame["y"].to_numpy(), frame["x"].to_numpy()
        v[at], filled[at] = frame["v"].to_numpy(), True
        v, depth = padded_plane(v, filled, most)
        y, x = np.nonzero(depth <= 0)
        return pd.DataFrame({atlas: key[0], "y": y, "x": x, "v": v[y, x], "depth": depth[y, x]})

    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    kind = dict(cells.dtypes)[atlas]
    return cells.where(inside).groupBy(atlas).applyInPandas(one, f"{atlas} {kind}, y long, x long, v long, depth long")


def mean_of(total: Column, weight: Column) -> Column:
    """Whole mean, rounded down; null without weight."""
    return F.floor(F.try_divide(total, weight)).cast("long")
