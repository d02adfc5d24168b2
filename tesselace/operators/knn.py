"""Exact two nearest neighbours; ties go to the lower id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "q long, i0 long, d0 long, i1 long, d1 long"


def quantised(v: Column) -> Column:
    """Components in -1..1 as integers 0..255."""
    return F.transform(v, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for integers; for floats the squared differences are added up component by component."""
    if a.dtype.kind == "i":
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out += gap * gap
    return out


def top_two(q_id, q_view, q_vec, ids, views, vecs) -> pd.DataFrame:
    """Two nearest rows of another view by (distance, id). Null where there are none.

    Matrix products give distances that are exact for whole numbers where a float type holds them all. For floats they
    are off by a bounded rounding error; what may be among the two nearest is then measured component by component."""
    whole = q_vec.dtype.kind == "i"
    order = np.argsort(ids, kind="stable")
    ids, views, vecs = ids[order], views[order], vecs[order]
    n, size = len(ids), vecs.shape[1]
    most = max((float(np.abs(x).max()) for x in (q_vec, vecs) if x.size), default=0.0)
    if whole:
        fast = next((t for t, bits in ((np.float32, 24), (np.float64, 53)) if 4 * size * most * most < 2.0**bits), None)
    else:
        fast = np.float64 if size * most * most < 1e300 else None  # NaN and infinity are measured one by one
    far = np.inf if fast or not whole else np.int64(2**62)
    base = vecs.astype(fast) if fast else None
    norms = (base * base).sum(1) if fast else None
    slack = 0.0 if whole else 16 * np.finfo(np.float64).eps * (size + 4) * size * most * most
    members = {v: np.flatnonzero(views == v) for v in np.unique(q_view)}
    got = np.zeros((2, len(q_id)), np.int64), np.full((2, len(q_id)), far, np.int64 if whole and not fast else np.float64)
    step = 64 if fast and n else 256
    for s in range(0, len(q_id) if n else 0, step):
        a, own = q_vec[s : s + step], q_view[s : s + step]
        rows = np.arange(len(a))
        if fast:
            left = a.astype(fast)
            d = left @ (-2 * base.T)
            d += norms
            d += (left * left).sum(1)[:, None]
        else:
            d = squared_distances(a, vecs)
        for v in np.unique(own):
            if len(members[v]):
                d[np.ix_(own == v, members[v])] = far
        if fast and not whole:
            i = d.argmin(1)
            least, d[rows, i] = d[rows, i], far
            second, d[rows, i] = d.min(1), least
            for r in rows:
                near = np.flatnonzero(d[r] <= second[r] + slack)
                near = near[d[r, near] < far]
                exact = np.concatenate([squared_distances(a[r : r + 1], vecs[near[k : k + 16384]])[0] for k in range(0, len(near), 16384)] or [np.zeros(0)])
                for k, i in enumerate(np.argsort(exact, kind="stable")[:2]):
                    got[0][k, s + r], got[1][k, s + r] = near[i], exact[i]
            continue
        for k in range(2):
            i = d.argmin(1)  # the first of equal distances: the lower id
            got[0][k, s : s + len(a)], got[1][k, s : s + len(a)] = i, d[rows, i]
            d[rows, i] = far
    out = {"q": pd.array(q_id, "Int64")}
    for k in range(2):
        none = ~(got[1][k] < far)
        out[f"i{k}"] = pd.arrays.IntegerArray(ids[got[0][k]].astype(np.int64) if n else np.zeros(len(q_id), np.int64), none)
        d = np.where(none, 0, got[1][k])
        out[f"d{k}"] = pd.arrays.IntegerArray(d.astype(np.int64), none.copy()) if whole else pd.arrays.FloatingArray(d.astype(np.float64), none.copy())
    return pd.DataFrame(out)[["q", "i0", "d0", "i1", "d1"]]


def blocked(frame: pd.DataFrame, dtype, size: int):
    vecs = np.array(frame["v"].tolist(), dtype).reshape(len(frame), size)
    return frame["id"].to_numpy(np.int64), frame["view"].fillna(-1).to_numpy(np.int64), vecs


def knn2(queries: DataFrame, base: DataFrame, broadcast_rows: int = 100_000, slices: int | None = None, broadcast_bytes: int = 256_000_000) -> DataFrame:
    """queries and base: (id, view, v), v of whole numbers, or of floats for distances as doubles.

    A base within both bounds is broadcast as one numpy block; a larger one is cut into slices and the queries into
    blocks, each slice meets each block once, and the partial pairs are merged by query. A query whose vector or id is
    null, or has no row of another view, has nulls; base rows with null vector or id take no part. A null view is a
    view of its own. All vectors have one length."""
    whole = "int" in dict(queries.dtypes)["v"]
    dtype, result = (np.int64, RESULT) if whole else (np.float64, RESULT.replace("d0 long", "d0 double").replace("d1 long", "d1 double"))
    base = base.select("id", "view", "v").where("id is not null and v is not null")
    asked = queries.select("id", "view", "v").where("id is not null and v is not null")
    odd = queries.where("id is null or v is null").select(F.col("id").alias("q"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in result.split(", ")[1:])))
    n, size = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = size or 0
    if slices is None:
        slices = 0 if n <= broadcast_rows and 8 * n * size <= broadcast_bytes else max(-(-n // broadcast_rows), -(-8 * n * size // broadcast_bytes))
    if not n:
        return asked.select(F.col("id").alias("q"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in result.split(", ")[1:]))).unionByName(odd)
    if not slices:
        shared = queries.sparkSession.sparkContext.broadcast(blocked(base.toArrow().to_pandas(), dtype, size))

        def search(it):
            for q in it:
                if len(q):
                    yield top_two(*blocked(q, dtype, size), *shared.value)

        return asked.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism).mapInPandas(search, result).unionByName(odd)
    per = max(1, n // slices)
    blocks = max(1, -(-asked.count() // per), -(-4 * queries.sparkSession.sparkContext.defaultParallelism // slices))
    cut = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def partial(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return top_two(*blocked(q, dtype, size), *blocked(b, dtype, size))

    left = asked.select("id", "view", "v", cut(blocks).alias("block"), every(slices).alias("slice")).groupBy("slice", "block")
    right = base.select("id", "view", "v", cut(slices).alias("slice"), every(blocks).alias("block")).groupBy("slice", "block")
    parts = left.cogroup(right).applyInPandas(partial, result)
    both = F.array(F.struct(F.col("d0").alias("d"), F.col("i0").alias("i")), F.struct(F.col("d1").alias("d"), F.col("i1").alias("i")))
    found = parts.select("q", F.explode(both).alias("x"))
    best = F.slice(F.array_sort(F.filter(F.collect_list("x"), lambda x: x["d"].isNotNull())), 1, 2)  # two of each slice
    merged = found.groupBy("q").agg(best.alias("b"))
    at = lambda k, c: F.get("b", F.lit(k))[c]
    return merged.select("q", at(0, "i").alias("i0"), at(0, "d").alias("d0"), at(1, "i").alias("i1"), at(1, "d").alias("d1")).unionByName(odd)


def ratio_test(pairs: DataFrame, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """Flag d0 < (numerator/denominator)^2 * d1, in integers."""
    return pairs.withColumn("passes", F.coalesce(F.col("d0") * denominator**2 < F.col("d1") * numerator**2, F.lit(False)))
