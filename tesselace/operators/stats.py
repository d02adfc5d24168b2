"""Comparison of tables, quantiles, tests and robust estimates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselace.operators.order import ranked


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join on keys: value_a, value_b and which side has the row."""
    joined = a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), keys, "full_outer")
    return joined.withColumn("found", F.when(F.col("value_a").isNull(), "second").when(F.col("value_b").isNull(), "first").otherwise("both"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side beyond those of the other, with the side; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def rank_quantiles(df: DataFrame, key: list[str], value: str, ties: list[str], percents: dict[str, int], interpolated: bool = False) -> DataFrame:
    """Quantiles of whole values by key, one column a name in `percents`, and n; no task holds a group.

    The value at rank min(n - 1, floor(n * p / 100)); interpolated: 100 times the value at (n - 1) * p / 100 between
    its neighbours, in whole numbers. `ties` tells rows of one value apart. Null values are left out."""
    rows = ranked(df.where(F.col(value).isNotNull()), key, [value, *ties], "__rank", "n")
    n, out = F.col("n"), []
    for name, p in percents.items():
        if interpolated:
            at, part = F.floor((n - 1) * p / 100).cast("long"), F.pmod((n - 1) * p, F.lit(100))
            high = F.least(at + 1, n - 1)
            made = F.when(F.col("__rank") == at, F.col(value) * (100 - part)).otherwise(0) + F.when(F.col("__rank") == high, F.col(value) * part).otherwise(0)
            out.append(F.sum(made).cast("long").alias(name))
        else:
            out.append(F.max(F.when(F.col("__rank") == F.least(n - 1, F.floor(n * p / 100)), F.col(value))).alias(name))
    return rows.groupBy(*key).agg(F.first("n").alias("n"), *out)


def welch(a_mean: Column, a_var: Column, a_n: Column, b_mean: Column, b_var: Column, b_n: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom.

    Of two arms without variance, t is 0 where their means are equal and infinite else, with the pooled degrees of
    freedom; an arm of one value counts as without variance, and fewer degrees than one do not occur."""
    u, v = (F.coalesce(F.when(n > 1, x / n), F.lit(0.0)) for x, n in ((a_var, a_n), (b_var, b_n)))
    gap, spread = a_mean - b_mean, F.sqrt(u + v)
    t = F.coalesce(F.try_divide(gap, spread), F.when(gap == 0, 0.0).when(gap > 0, float("inf")).otherwise(float("-inf")))
    rest = F.greatest(a_n + b_n - 2, F.lit(1)).cast("double")
    part = lambda x, n: F.when(n > 1, x * x / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    return t, F.coalesce(F.try_divide((u + v) * (u + v), part(u, a_n) + part(v, b_n)), rest)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or tiny), 1 + k / c or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([beta_fraction(n / 2, 0.5, n / (n + x * x) if math.isfinite(x) else 0.0) if n == n and x == x else float("nan") for x, n in zip(t, df, strict=True)])


def two_sided(t: str, df: str) -> Column:
    """Two-sided p of Student's t."""
    return F.pandas_udf(_two_sided, "double")(t, df)


def verdict(p: Column, better: Column, worse_by: Column, tolerance: float, level: float = 0.05) -> Column:
    """PASS if not significant or better, WARN if worse within tolerance, else FAIL."""
    return F.when((p >= level) | better, "PASS").when(worse_by <= tolerance, "WARN").otherwise("FAIL")


def huber(s: Column, b: int) -> Column:
    """Of a squared residual s: s up to b^2, then 2 b sqrt(s) - b^2."""
    return F.when(s <= b * b, s).otherwise(2 * b * F.sqrt(s) - b * b)


def huber_slopes(s: Column, b: int) -> tuple[Column, Column]:
    """First and second derivative of huber by s: what residuals and Jacobians are scaled by."""
    root = F.sqrt(s)
    far = s > b * b
    return F.when(far, b / root).otherwise(1.0), F.when(far, -b / (2 * s * root)).otherwise(0.0)


def best_cutoff(residuals: DataFrame, group: str, residual: str, sample: int, log_alpha: float) -> DataFrame:
    """A-contrario choice by group: the k residuals, in order, for which log C(n, k) + log C(k, sample) + (k - sample)
    (log_alpha + log r_k) is least; groups are bounded (matches of one pair of views). Zero residuals count as 1e-12."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.sort(frame[residual].to_numpy(float))
        n = len(r)
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
        k = np.arange(sample + 1, n + 1)
        choose = lambda a, b: logs[a] - logs[b] - logs[a - b]
        values = choose(n, k) + choose(k, sample) + (k - sample) * (log_alpha + np.log(np.maximum(r[k - 1], 1e-12))) if len(k) else np.array([])
        i = int(values.argmin()) if len(values) else -1
        return pd.DataFrame({group: [frame[group].iloc[0]], "n": [n], "inliers": [int(k[i]) if i >= 0 else 0], "log_nfa": [float(values[i]) if i >= 0 else None]})

    kind = dict(residuals.dtypes)[group]
    return residuals.where(F.col(residual) >= 0).groupBy(group).applyInPandas(one, f"{group} {kind}, n long, inliers long, log_nfa double")


def moments(pairs: DataFrame, group: str) -> DataFrame:
    """Sums by group of the coordinates (x, y, z) and (u, v, w), of their products and of both squares."""
    a, b = ("x", "y", "z"), ("u", "v", "w")
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in a + b), *(F.sum(F.col(i) * F.col(j)).alias(f"s_{i}{j}") for i in a for j in b)]
    sums += [F.sum(sum((F.col(c) * F.col(c) for c in s), F.lit(0))).alias(f"q_{s[0]}") for s in (a, b)]
    return pairs.groupBy(group).agg(*sums)


def median_rotation(rotations: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The rotation with least sum of angles to the given ones (n, 3, 3), by Weiszfeld steps on their logarithms."""

    def log(r: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip((np.trace(r, axis1=-2, axis2=-1) - 1) / 2, -1, 1))
        axis = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], -1)
        return axis * np.where(angle < 1e-8, 0.5, angle / np.maximum(2 * np.sin(angle), 1e-12))[..., None]

    u, _, vt = np.linalg.svd(rotations.sum(0))
    middle = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
    for _ in range(rounds):
        way = log(rotations @ middle.T)
        far = np.maximum(np.linalg.norm(way, axis=1), 1e-12)
        step = (way / far[:, None]).sum(0) / (1 / far).sum()
        angle = float(np.linalg.norm(step))
        if angle < 1e-12:
            break
        k = np.array([[0, -step[2], step[1]], [step[2], 0, -step[0]], [-step[1], step[0], 0]]) / angle
        middle = (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k) @ middle
    return middle


def similarity(pairs: DataFrame, group: str) -> DataFrame:
    """Least-squares similarity per group from (x, y, z) to (u, v, w): scale, rotation (row-major), translation, rms.

    Only sums reach the last step: moments are aggregated by Spark, and a 3 x 3 SVD follows for each group."""
    a, b = ("x", "y", "z"), ("u", "v", "w")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            n = r["n"]
            p, q = (np.array([r[f"s_{c}"] for c in s]) / n for s in (a, b))
            cov = np.array([[r[f"s_{i}{j}"] for i in a] for j in b]) / n - np.outer(q, p)
            u, d, vt = np.linalg.svd(cov)
            sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
            rotation = u @ sign @ vt
            var_p, var_q = r["q_x"] / n - p @ p, r["q_u"] / n - q @ q
            scale = float((d * np.diag(sign)).sum() / var_p) if var_p > 0 else 1.0
            shift = q - scale * rotation @ p
            rms = math.sqrt(max(0.0, var_q - scale**2 * var_p)) if var_p > 0 else 0.0
            out.append((r[group], n, scale, rotation.ravel().tolist(), shift.tolist(), rms))
        return pd.DataFrame(out, columns=[group, "n", "scale", "rotation", "shift", "rms"])

    kind = dict(pairs.dtypes)[group]
    return moments(pairs, group).mapInPandas(lambda it: map(solve, it), f"{group} {kind}, n long, scale double, rotation array<double>, shift array<double>, rms double")
