"""Operators against plain Python twins, with ties, empty inputs and holes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselace.operators import graph, raster, stats, votes
from tesselace.operators.knn import knn2
from tesselace.operators.radius import radius_pairs


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, view long, v array<int>")


@pytest.mark.parametrize("slices", [0, 3])
def test_two_nearest_with_ties(spark, slices):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.randint(0, 2) for _ in range(4)]) for i in range(40)]
    got = {r.q: (r.i0, r.d0, r.i1, r.d1) for r in knn2(vectors(spark, rows), vectors(spark, rows), slices=slices).collect()}
    for q, view, v in rows:
        best = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, o, w in rows if o != view)[:2]
        assert got[q] == (best[0][1], best[0][0], best[1][1], best[1][0])


def test_two_nearest_of_few(spark):
    one = vectors(spark, [(1, 0, [1, 2])])
    two = vectors(spark, [(1, 0, [1, 2]), (2, 1, [1, 3])])
    assert knn2(one, one, slices=0).first()[1:] == (None, None, None, None)
    assert knn2(one, two, slices=0).first()[1:] == (2, 1, None, None)
    assert knn2(one, vectors(spark, []), slices=2).count() in (0, 1)


def test_radius_pairs_are_found_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(-30, 30), rng.randint(-30, 30)) for i in range(80)]
    got = sorted((r.a, r.b, r.d2) for r in radius_pairs(spark.createDataFrame(rows, "id long, x long, y long"), ["x", "y"], 7).collect())
    want = sorted((a[0], b[0], (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 49)
    assert got == want


def test_suppression_in_index_order(spark):
    nodes = spark.range(7).withColumnRenamed("id", "id")
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 5)]
    got = {r.id: r.survives for r in graph.suppressed(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    want: dict[int, bool] = {}
    for i in range(7):
        want[i] = not any(b == i and want[a] for a, b in edges)
    assert got == want


def test_erasing_cascades(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("c", 3)]
    left = graph.pruned(spark.createDataFrame(rows, "landmark string, view long"), 2, 2)
    assert sorted(map(tuple, left.collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_min_cut_value(spark):
    rows = [(0, -1, 1, 3), (0, -1, 2, 2), (0, 1, 2, 1), (0, 1, -2, 2), (0, 2, -2, 3), (1, -1, 9, 5), (1, 9, -2, 4)]
    e = spark.createDataFrame([(*r, -1, -2) for r in rows], "component long, src long, dst long, cap long, source long, sink long")
    assert sorted(map(tuple, graph.min_cut(e).collect())) == [(0, 5), (1, 4)]


def test_stencil_renormalises(spark):
    grid = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (0, 3, 40)], "y long, x long, v long")
    got = {r.x: (r.total, r.weight) for r in raster.stencil(grid, "y", "x", "v", {-1: 1, 0: 2, 1: 1}).collect()}
    assert got == {0: (40, 3), 1: (50, 3), 3: (80, 2)}


def test_modal_counts(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False)], "cell long, k long, a boolean")
    assert votes.modal_counts(rows, "cell", "k", rows["a"]).first()[1:] == (1, 2)


def test_path_costs(spark):
    rows = [(0, x, l, abs((x * 3) % 5 - l)) for x in range(6) for l in range(3)]
    got = {(r.x, r.label): r.path_cost for r in raster.path_costs(spark.createDataFrame(rows, "y long, x long, label long, cost long"), "y", "x", "label", "cost", 1, 3).collect()}
    cost = {(x, l): c for _, x, l, c in rows}
    for x in range(6):
        for l in range(3):
            if x == 0:
                assert got[x, l] == cost[x, l]
            else:
                prev = [got[x - 1, k] for k in range(3)]
                near = [prev[k] + 1 for k in (l - 1, l + 1) if 0 <= k < 3]
                assert got[x, l] == cost[x, l] + min(prev[l], *near, min(prev) + 3) - min(prev)


def test_student_p():
    # two-sided p of t = 2.228 with 10 degrees of freedom is 0.05, of t = 12.706 with 1 as well
    for t, n in ((2.2281388519649385, 10), (12.706204736432095, 1)):
        assert abs(stats.beta_fraction(n / 2, 0.5, n / (n + t * t)) - 0.05) < 1e-10


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(30, 3))
    q = 1.5 * p @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]).T + [1, 2, 3]
    rows = [(0, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    r = stats.similarity(spark.createDataFrame(rows, "g long, x double, y double, z double, u double, v double, w double"), "g").first()
    assert abs(r.scale - 1.5) < 1e-9 and np.allclose(r.shift, [1, 2, 3]) and r.rms < 1e-6


def test_best_cutoff_prefers_the_cluster(spark):
    rows = [(0, 0.001 * k) for k in range(1, 41)] + [(0, 0.5 + 0.1 * k) for k in range(20)]
    r = stats.best_cutoff(spark.createDataFrame(rows, "g long, r double"), "g", "r", 7, math.log(0.5)).first()
    assert r.inliers == 40


def test_levels_and_empty_front(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (5, 6)], "src long, dst long")
    got = sorted(map(tuple, graph.levels(e, spark.createDataFrame([(1,)], "node long")).collect()))
    assert got == [(1, 0), (2, 1), (3, 1)]


@pytest.mark.parametrize("top", [1, 255, 10**6])
def test_blocks_give_exact_distances(top):
    """Matrix products must not round: whole numbers, floats with ties and near ties, views without others."""
    from tesselace.operators import knn

    r = np.random.default_rng(top)
    for kind in (np.int64, np.float64):
        vecs = r.integers(0, top + 1, (150, 64)).astype(kind) * (1 if kind is np.int64 else 0.1)
        views, ids = r.integers(0, 2, 150), r.permutation(150) * 3
        got = knn.top_two(ids[:70], views[:70], vecs[:70], ids, views, vecs)
        assert all(str(t) in ("Int64", "Float64") for t in got.dtypes)
        for row, (v, x) in zip(got.itertuples(index=False), zip(views, vecs)):
            want = sorted((knn.squared_distances(x[None], y[None])[0, 0], k) for k, w, y in zip(ids, views, vecs) if w != v)[:2]
            assert [(row.d0, row.i0), (row.d1, row.i1)] == want


def test_blocks_are_measured_by_products(monkeypatch):
    from tesselace.operators import knn

    r, calls, exact = np.random.default_rng(2), [], knn.squared_distances
    monkeypatch.setattr(knn, "squared_distances", lambda a, b: calls.append(len(a) * len(b)) or exact(a, b))
    x = r.normal(size=(400, 64))
    knn.top_two(np.arange(400), np.arange(400) % 3, x, np.arange(400), np.arange(400) % 3, x)
    assert sum(calls) < 4 * 400


def test_large_keys_are_spread(spark):
    from tesselace.operators.radius import pairs_within, spread_join

    a = spark.createDataFrame([(k % 3 if k % 10 else None, k) for k in range(120)], "g long, x long")
    b = spark.createDataFrame([(0 if k < 60 else 1, k) for k in range(80)], "g long, y long")
    dealt = spread_join(a, b, ["g"], most=50)
    want = sorted((r.g, r.x, s.y) for r in a.collect() for s in b.collect() if r.g == s.g)
    assert sorted((r.g, r.x, r.y) for r in dealt.collect()) == want
    tasks = dealt.groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < len(want) / 4  # two keys have pairs
    p = [(k, k % 2 if k % 9 else None) for k in range(40)]
    points = spark.createDataFrame(p, "id long, view long")
    for mark in (None, 7):
        got = pairs_within(points, "view", None if mark is None else F.col("id") % mark == 0)
        assert sorted(map(tuple, got.collect())) == [(i, j) for i, v in p for j, w in p if i < j and v == w and v is not None and (mark is None or i % mark == 0 or j % mark == 0)]


def test_pairs_of_repeated_ids(spark, tmp_path):
    """Ids that repeat, with different labels, still give each pair once, as the SQL does."""
    import duckdb

    from tesselace.plans import registry

    r = np.random.default_rng(4)
    rows = [(int(k % 50), [float(x) for x in r.integers(-60, 60, 64) / 1000], int(r.integers(0, 3)) if k % 8 else None) for k in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("pairs_replaced", "pairs_union", "pairs_caught"):
        got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select("a", "b").collect()))
        assert got and got == sorted(c.execute(registry.oracle_sql()[name]).fetchall())


def test_ranges_do_not_grow(spark, monkeypatch):
    from tesselace.operators import order

    monkeypatch.setattr(order, "RANGE_ROWS", 50)
    kept, save = [], order.saved
    monkeypatch.setattr(order, "saved", lambda df, tag: kept.append(save(df, tag)) or kept[-1])
    got = order.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "at")
    assert sorted((r.k, r.at) for r in got.collect()) == [(k, k) for k in range(1000)]
    sizes = [r["count"] for r in kept[-1].groupBy("__part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150
