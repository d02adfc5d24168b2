"""Stencils and resampling over (row, x, value) grids with holes; integer taps, one division at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stencil(grid: DataFrame, row: str, x: str, value: str, taps: dict[int, int]) -> DataFrame:
    """Weighted mean over the cells that exist, as integers: total and weight (the caller divides).

    Each cell is sent to the cells that it contributes to, so there is one aggregation and no self-join."""
    pairs = F.array(*(F.struct(F.lit(-d).alias("d"), F.lit(w).alias("w")) for d, w in taps.items()))
    sent = grid.select(row, x, value, F.explode(pairs).alias("t"))
    hit = sent.select(row, (F.col(x) + F.col("t.d")).alias(x), (F.col(value) * F.col("t.w")).alias("part"), F.col("t.w").alias("w"), (F.col("t.d") == 0).alias("own"))
    return hit.groupBy(row, x).agg(F.sum("part").cast("long").alias("total"), F.sum("w").cast("long").alias("weight"), F.max("own").alias("own")).where("own").drop("own")


def downscale(grid: DataFrame, row: str, x: str, value: str, factor: int, taps: dict[int, int]) -> DataFrame:
    """Every factor-th cell of the stencil (renormalised at borders and holes)."""
    return stencil(grid, row, x, value, taps).where(F.pmod(F.col(x), F.lit(factor)) == 0).withColumn(x, (F.col(x) / factor).cast("long"))


def band_difference(grid: DataFrame, row: str, x: str, value: str, taps: dict[int, int]) -> DataFrame:
    """value * weight - total: a cell against its smoothed neighbourhood, in units of 1/weight."""
    smooth = stencil(grid, row, x, value, taps)
    return grid.join(smooth, [row, x]).select(row, x, (F.col(value) * F.col("weight") - F.col("total")).cast("long").alias("detail"), "weight")


def central_difference(grid: DataFrame, row: str, x: str, value: str) -> DataFrame:
    """Twice the slope: central inside, one-sided (doubled) at the ends; 0 for a single cell."""
    w = Window.partitionBy(row).orderBy(x)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return grid.withColumn("slope2", F.when(before.isNull() & after.isNull(), 0).when(before.isNull(), 2 * (after - F.col(value))).when(after.isNull(), 2 * (F.col(value) - before)).otherwise(after - before).cast("long"))


def path_costs(grid: DataFrame, row: str, x: str, label: str, cost: str, p1: int, p2: int) -> DataFrame:
    """Dynamic programme along x: c + min(prev, prev of the adjacent labels + p1, min(prev) + p2) - min(prev).

    One scan line is one group; a line is bounded by the raster's width times its labels."""
    import numpy as np
    import pandas as pd

    def line(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index=x, columns=label, values=cost).sort_index().sort_index(axis=1)
        c = table.to_numpy(np.int64)
        out = c.copy()
        for i in range(1, len(c)):
            prev = out[i - 1]
            low = prev.min()
            best = np.minimum(prev, low + p2)
            best[1:] = np.minimum(best[1:], prev[:-1] + p1)
            best[:-1] = np.minimum(best[:-1], prev[1:] + p1)
            out[i] = c[i] + best - low
        made = pd.DataFrame(out, index=table.index, columns=table.columns).stack().rename("path_cost").reset_index()
        made.insert(0, row, frame[row].iloc[0])
        return made

    kinds = dict(grid.dtypes)
    return grid.groupBy(row).applyInPandas(line, f"{row} {kinds[row]}, {x} {kinds[x]}, {label} {kinds[label]}, path_cost long")
