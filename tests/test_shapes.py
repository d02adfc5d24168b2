"""Surfaces, scenes, images and ranks against plain Python twins; nulls, ties, empty tables and holes."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselace.functions import shapes
from tesselace.operators import graph, image, order, scene, stats, surface
from tesselace.operators.knn import knn2
from tesselace.plans import registry


def closest_by_search(p, a, b, c, n=200):
    """Least squared distance over a fine grid of the triangle's weights."""
    i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    keep = i + j <= n
    v, w = i[keep] / n, j[keep] / n
    q = a + v[:, None] * (b - a) + w[:, None] * (c - a)
    return ((q - p) ** 2).sum(1).min()


def triangle_rows(rng, n):
    return [(k, *(float(rng.randint(-20, 20)) for _ in range(9))) for k in range(n)]


def triangle_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in surface.CORNERS))


def test_closest_points_are_closest(spark):
    rng = random.Random(1)
    rows = triangle_rows(rng, 60)
    rows.append((60, *([1.0, 2.0, 3.0] * 3)))  # a triangle that is a point
    rows.append((61, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 8.0, 0.0, 0.0))  # one that is a segment
    points = [(k, *(float(rng.randint(-30, 30)) for _ in range(3))) for k in range(62)]
    both = triangle_frame(spark, rows).join(spark.createDataFrame(points, "id long, x double, y double, z double"), "id")
    for r in surface.closest_points(both).collect():
        a, b, c = (np.array([r[f"{k}{x}"] for x in "xyz"]) for k in "abc")
        p = np.array([r.x, r.y, r.z])
        want = closest_by_search(p, a, b, c)
        assert r.d2 <= want + 1e-9 and want - r.d2 <= 0.02 * (1 + want)
        assert r.v >= 0 and r.w >= 0 and r.v + r.w <= 1 + 1e-12


def test_nearest_triangles(spark):
    rng = random.Random(2)
    rows = triangle_rows(rng, 30)
    points = [(k, *(float(rng.randint(-80, 80)) for _ in range(3))) for k in range(40)]
    t, p = triangle_frame(spark, rows), spark.createDataFrame(points, "id long, x double, y double, z double")
    got = {r.id: (r.triangle, r.d2) for r in surface.nearest_triangles(p, t, 7.0).collect()}
    every = surface.closest_points(p.crossJoin(t.withColumnRenamed("id", "triangle")))
    want = {r.id: (r.b.triangle, r.b.d2) for r in every.groupBy("id").agg(F.min(F.struct("d2", "triangle")).alias("b")).collect()}
    assert got == want
    assert [tuple(r)[1:] for r in surface.nearest_triangles(p.limit(1), t.limit(0), 7.0).collect()] == [(None,) * 5]
    assert surface.nearest_triangles(p.limit(0), t, 7.0).count() == 0


def test_refined_finds_the_move(spark):
    rng = np.random.default_rng(3)
    grid = [(float(x), float(y), float(5 * math.sin(x / 3) + 4 * math.cos(y / 4))) for x in range(-10, 11, 2) for y in range(-10, 11, 2)]
    at = {(x, y): (x, y, z) for x, y, z in grid}
    faces = []
    for x, y in itertools.product(range(-10, 10, 2), repeat=2):
        a, b, c, d = (at[float(x + i), float(y + j)] for i, j in ((0, 0), (2, 0), (2, 2), (0, 2)))
        faces += [(*a, *b, *c), (*a, *c, *d)]
    t = triangle_frame(spark, [(k, *f) for k, f in enumerate(faces)])
    picks, weights = rng.integers(0, len(faces), 150), rng.dirichlet((1, 1, 1), 150)
    p = np.array([np.array(faces[k]).reshape(3, 3).T @ w for k, w in zip(picks, weights)])
    angle = 0.04
    turn = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    moved = (p - [0.3, -0.2, 0.25]) @ turn / 1.01
    frame = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(moved)], "id long, x double, y double, z double")
    matrix, shift, rms = surface.refined(frame, t, 2.0, rounds=8, keep=0.95)
    assert rms < 0.02 and np.abs(moved @ matrix.T + shift - p).max() < 0.1


def test_sampling_by_weight(spark):
    w = spark.createDataFrame([(5, 3), (1, 2), (9, 0), (7, 4)], "id long, weight long")
    at = spark.createDataFrame([(k, k) for k in range(9)], "sample long, at long")
    got = {r.sample: r.id for r in surface.sampled(w, at, 2).collect()}
    assert got == dict(enumerate([1, 1, 5, 5, 5, 7, 7, 7, 7]))


def test_facets_and_shared_cells(spark):
    cells = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [4, 2, 3, 5]), (3, [6, 7, 8, 9])], "cell long, vertices array<long>")
    assert [tuple(r) for r in surface.shared_facets(cells).collect()] == [(1, 2, [2, 3, 4])]
    pairs = spark.createDataFrame([(2, 3), (1, 5), (4, 4), (1, 99)], "a long, b long")
    assert {(r.a, r.b): r.shared for r in surface.share_a_cell(pairs, cells).collect()} == {(2, 3): 2, (1, 5): 0, (4, 4): 2, (1, 99): 0}


def test_numbers_and_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), rng.randint(0, 9), k) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, v long, k long").repartition(5)
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r.k: r.number for r in order.numbered(df, ["v", "k"]).collect()} == want
    got = order.ranked(df, ["g"], ["v", "k"], "at", "n").collect()
    for g in range(3):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert {r.k: (r.at, r.n) for r in got if r.g == g} == {r[2]: (i, len(mine)) for i, r in enumerate(mine)}
    assert order.numbered(df.limit(0), ["k"]).count() == 0
    q = {r.g: (r.a, r.b) for r in stats.rank_quantiles(df, ["g"], "v", ["k"], {"a": 50, "b": 95}, interpolated=True).collect()}
    for g in range(3):
        mine = [r[1] for r in rows if r[0] == g]
        assert q[g] == pytest.approx([100 * x for x in np.percentile(mine, [50, 95])])


def test_welch_without_variance(spark):
    rows = [(1.0, 0.0, 3, 1.0, 0.0, 3), (2.0, 0.0, 3, 1.0, 0.0, 4), (1.0, None, 1, 2.0, 1.0, 5), (1.0, 1.0, 4, 1.5, 2.0, 5)]
    df = spark.createDataFrame(rows, "a double, va double, na long, b double, vb double, nb long")
    t, n = stats.welch(*(F.col(c) for c in ("a", "va", "na", "b", "vb", "nb")))
    got = df.select(t.alias("t"), n.alias("df")).withColumn("p", stats.two_sided("t", "df")).collect()
    assert (got[0].t, got[0].df, got[0].p) == (0.0, 4.0, 1.0) and (got[1].t, got[1].p) == (float("inf"), 0.0)
    assert got[2].t == pytest.approx(-1 / math.sqrt(0.2)) and got[2].df == pytest.approx(4.0)
    u, v = 0.25, 0.4
    assert got[3].df == pytest.approx((u + v) ** 2 / (u * u / 3 + v * v / 4))


def test_two_nearest_of_odd_rows(spark):
    rows = [(1, 0, [1, 2]), (2, 1, [1, 3]), (3, 1, None), (None, 1, [0, 0]), (4, None, [5, 5])]
    x = spark.createDataFrame(rows, "id long, view long, v array<int>")
    for slices in (0, 2):
        got = {r.q: tuple(r)[1:] for r in knn2(x, x, slices=slices).collect()}
        assert got[1] == (2, 1, 4, 25) and got[3] == (None,) * 4 and got[None] == (None,) * 4 and got[4] == (2, 20, 1, 25)
    assert knn2(x, x.limit(0)).where("i0 is null").count() == 5
    y = spark.createDataFrame([(1, 0, [0.5]), (2, 1, [0.75]), (3, 1, [2.0])], "id long, view long, v array<double>")
    assert {r.q: (r.i0, r.d0, r.i1) for r in knn2(y, y).collect()} == {1: (2, 0.0625, 3), 2: (1, 0.0625, None), 3: (1, 2.25, None)}


def test_band_votes_and_outliers(spark):
    rng = random.Random(5)
    target = [(y, x, rng.randint(0, 50)) for y in range(5) for x in range(6) if rng.random() < 0.8]
    others = [(v, y, x, rng.randint(0, 50)) for v in "ab" for y in range(5) for x in range(6) if rng.random() < 0.8]
    got = {(r.y, r.x): (r.votes, r.voters) for r in scene.band_votes(spark.createDataFrame(target, "y long, x long, depth long"), spark.createDataFrame(others, "voter string, y long, x long, depth long"), 1, 10).collect()}
    for y, x, depth in target:
        hit = [o[0] for o in others if abs(o[1] - y) <= 1 and abs(o[2] - x) <= 1 and abs(o[3] - depth) < 10]
        assert got[y, x] == (len(hit), len(set(hit)))
    rows = [(1, 2.0, 1.0), (1, -1.0, 0.0), (1, None, 0.0), (1, 1.0, 99.0), (1, 1.0, 4.0), (2, 1.0, None)]
    out = scene.outliers(spark.createDataFrame(rows, "landmark long, depth double, s double"), 2, 1).collect()
    assert [tuple(r) for r in out] == [(1, 2, 2, 1)]


def dense_system(rows, damping):
    views, marks = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    jac, res = np.zeros((len(rows), len(views) + len(marks))), np.array([r[4] for r in rows])
    for k, (m, v, a, b, _) in enumerate(rows):
        jac[k, views.index(v)], jac[k, len(views) + marks.index(m)] = a, b
    h = jac.T @ jac
    return np.linalg.solve(h + damping * np.diag(np.diag(h)), jac.T @ res)[: len(views)], views


def test_elimination_is_that_of_the_dense_system(spark):
    rng = random.Random(6)
    rows = [(m, v, rng.uniform(0.5, 2), rng.uniform(0.5, 2), rng.uniform(-1, 1)) for m in range(12) for v in range(4) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "landmark long, view long, a double, b double, r double")
    got = scene.solved(*scene.eliminated(df, 0.1))
    want, views = dense_system(rows, 0.1)
    assert [got[v] for v in views] == pytest.approx(list(want))


def test_factors_are_found(spark):
    rng = random.Random(7)
    p, q = {v: rng.uniform(0.5, 2) for v in range(5)}, {m: rng.uniform(1, 3) for m in range(20)}
    rows = [(m, v, p[v] * q[m]) for m in q for v in p if rng.random() < 0.6]
    views, marks, costs = scene.factorised(spark.createDataFrame(rows, "landmark long, view long, value double"), rounds=12)
    assert costs[-1] < 1e-8 * costs[0] and all(b < a for a, b in zip(costs, costs[1:]))
    made_p, made_q = {r.view: r.p for r in views.collect()}, {r.landmark: r.q for r in marks.collect()}
    assert all(abs(made_p[v] * made_q[m] - x) < 1e-3 for m, v, x in rows)


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_plane_maps(spark, batch):
    rng = random.Random(8)
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.95, 3], [1e-4, 2e-4, 1]])
    rows = []
    for k in range(60):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        u, v, w = h @ [x, y, 1]
        rows.append((0, x, y, float(u / w), float(v / w)) if k < 42 else (0, x, y, rng.uniform(0, 100), rng.uniform(0, 100)))
    rows += [(1, float(k), 0.0, 0.0, 0.0) for k in range(3)]
    got = {r.g: r for r in scene.homographies(spark.createDataFrame(rows, "g long, x double, y double, u double, v double"), "g", tries=128, batch=batch, area=1e4).collect()}
    assert got[0].inliers == 42 and np.allclose(np.array(got[0].model).reshape(3, 3) / got[0].model[8], h, atol=1e-5)
    assert (got[1].n, got[1].inliers, got[1].model) == (3, 0, None)
    again = scene.homographies(spark.createDataFrame(rows[::-1], "g long, x double, y double, u double, v double"), "g", tries=128, batch=5, area=1e4).where("g = 0").first()
    assert again.log_nfa == got[0].log_nfa


def test_bound_is_below_all_scores():
    rng = np.random.default_rng(9)
    n, k = 80, np.arange(5, 81)
    logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
    base = (logs[n] - logs[k] - logs[n - k]) + (logs[k] - logs[4] - logs[k - 4])
    for _ in range(50):
        r2 = np.exp(rng.normal(0, 3, n))
        assert scene.least_score(r2, base, k, -5.0) <= (base + (k - 4) * (-5.0 + np.log(np.sort(r2)[k - 1]))).min()


def test_cuts_by_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for c in range(6):
        for a, b in itertools.permutations([-1, 1, 2, 3, -2], 2):
            if a != -2 and b != -1 and rng.random() < 0.7:
                rows.append((c, a, b, rng.randint(0, 9), -1, -2))
    frame = spark.createDataFrame(rows, "component long, src long, dst long, cap long, source long, sink long")
    got = collections.defaultdict(dict)
    flow = {}
    for r in graph.min_cut_labels(frame).collect():
        got[r.component][r.node], flow[r.component] = r.sink_side, r.flow
    for c in flow:
        mine = [r for r in rows if r[0] == c]
        cut = lambda t: sum(r[3] for r in mine if r[1] not in t and r[2] in t)
        best = min(cut({-2, *some}) for n in range(4) for some in itertools.combinations([1, 2, 3], n))
        assert flow[c] == best == cut({n for n, side in got[c].items() if side}) and got[c][-2] and not got[c][-1]
    with pytest.raises(ValueError):
        graph.min_cut_labels(frame, most_edges=3)


def test_registered_cut_is_the_flow(spark, sf):
    """The cut of the labels of the registered graph has the flow's value: both are then the least."""
    from tesselace.plans.grids import cut_edges

    e = cut_edges(spark, sf)
    labels = graph.min_cut_labels(e)
    side = lambda c: labels.select("component", F.col("node").alias(c), F.col("sink_side").alias(f"{c}_side"))
    cut = e.join(side("src"), ["component", "src"]).join(side("dst"), ["component", "dst"]).where("not src_side and dst_side").groupBy("component").agg(F.sum("cap").alias("cut"))
    flows = {r.component: r.flow for r in registry.queries()["min_cut_components"](spark, sf).collect()}
    assert flows and {r.component: r.cut for r in cut.collect()} == {c: f for c, f in flows.items() if f}


def test_large_components_are_cut_as_tables(spark):
    """A component beyond task_edges is no task's (there was no such bound before); flow and labels are those of one task."""
    rng = random.Random(3)
    rows = []
    for c, n in enumerate((4, 9, 14)):
        nodes = [-1, -2, *range(1, n)]
        rows += [(c, rng.choice(nodes), rng.choice(nodes), rng.choice([0, 1, 2, 9]), -1, -2) for _ in range(5 * n)]
    rows += [(3, -1, 1, 4, -1, -2), (3, 2, -2, 4, -1, -2)]  # no way to the sink
    frame = spark.createDataFrame(rows, "component long, src long, dst long, cap long, source long, sink long")
    want = sorted(map(tuple, graph.min_cut_labels(frame).collect()))
    assert sorted(map(tuple, graph.min_cut_labels(frame, task_edges=30).collect())) == want
    assert sorted(map(tuple, graph.min_cut(frame, task_edges=0).collect())) == sorted({w[:2] for w in want}) and len({w[1] for w in want}) > 1


def test_registered_suppression_and_erasing(spark, sf):
    from tesselace.operators.radius import radius_pairs
    from tesselace.plans.vectors import points

    pairs = [(r.a, r.b) for r in radius_pairs(points(spark, sf), ["x", "y", "z"], 60).collect()]
    before = collections.defaultdict(list)
    for a, b in pairs:
        before[b].append(a)
    want: dict = {}
    got = {r.id: r.survives for r in registry.queries()["suppression"](spark, sf).collect()}
    for i in sorted(got):
        want[i] = not any(want[a] for a in before[i])
    assert got == want
    left = {(r.l_orderkey, r.l_suppkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()}
    while True:
        marks, views = collections.Counter(a for a, _ in left), collections.Counter(b for _, b in left)
        now = {(a, b) for a, b in left if marks[a] >= 3}
        views = collections.Counter(b for _, b in now)
        now = {(a, b) for a, b in now if views[b] >= 5}
        if now == left:
            break
        left = now
    assert {(r.landmark, r.view) for r in registry.queries()["unstable_erase"](spark, sf).collect()} == left


def test_registered_tests_have_the_right_p(spark, sf):
    """Two-sided p by numeric integration of Student's density."""
    rows = registry.queries()["welch_verdicts"](spark, sf).collect()
    for r in rows:
        x = np.linspace(0, abs(r.t), 20_001)
        density = np.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi) * (1 + x * x / r.df) ** (-(r.df + 1) / 2)
        assert r.p == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-6)
        assert r.verdict == ("PASS" if r.p >= 0.05 or r.t < 0 else "WARN" if abs(r.t) <= 3 else "FAIL")


def test_padding_is_the_sequential_sweep():
    rng = np.random.default_rng(11)
    for most in (1, 3, 9):
        v, filled = rng.integers(1, 99, (7, 9)), rng.random((7, 9)) < 0.2
        want, depth = np.where(filled, v, 0), np.where(filled, 0, 1)
        for rows, cols, d in ((range(7), range(9), 1), (range(6, -1, -1), range(8, -1, -1), -1)):
            for i in rows:
                for j in cols:
                    for a, b in ((i, j - d), (i - d, j)):
                        if depth[i, j] == 1 and 0 <= a < 7 and 0 <= b < 9 and -most < depth[a, b] <= 0:
                            want[i, j], depth[i, j] = want[a, b], depth[a, b] - 1
        got, made = image.padded_plane(np.where(filled, v, 0), filled, most)
        assert (made == depth).all() and (got[depth <= 0] == want[depth <= 0]).all()


def test_path_means_add_up_directions(spark):
    rng = random.Random(12)
    rows = [(y, x, l, rng.randint(0, 20)) for y in range(3) for x in range(4) for l in range(3)]
    cost = {r[:3]: r[3] for r in rows}

    def walk(line):
        out, prev = [], None
        for cells in line:
            c = [cost[*cells, l] for l in range(3)]
            if prev:
                c = [c[l] + min([prev[l], min(prev) + 7] + [prev[k] + 2 for k in (l - 1, l + 1) if 0 <= k < 3]) - min(prev) for l in range(3)]
            out.append((cells, c))
            prev = c
        return out

    want = collections.Counter()
    lines = [[(y, x) for x in range(4)] for y in range(3)] + [[(y, x) for y in range(3)] for x in range(4)]
    for line in lines:
        for way in (line, line[::-1]):
            for cells, c in walk(way):
                for l in range(3):
                    want[*cells, l] += c[l]
    got = image.path_means(spark.createDataFrame(rows, "y long, x long, label long, cost long"), "y", "x", "label", "cost", 2, 7).collect()
    assert {(r.y, r.x, r.label): r.total for r in got} == want and {r.n for r in got} == {4}


def test_plane_geometry(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(shapes.crossing(lit(0, 0), lit(1, 1), lit(4, 0), lit(0, 1)), shapes.crossing(lit(0, 0), lit(1, 1), lit(1, 0), lit(2, 2)))[:] == (4.0, None)
    assert one(shapes.border_crossings(lit(-5, 5), lit(1, 0), 10, 20), shapes.border_crossings(lit(-5, 50), lit(1, 0), 10, 20))[:] == ([5.0, 15.0], [])
    assert one(*shapes.between_lines(lit(0, 0, 0), lit(1, 0, 0), lit(3, 5, 2), lit(0, 1, 0)))[:] == (3.0, 0.0, 1.0)
    assert one(shapes.pixel_size([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], lit(3, 0, 4), 100.0))[0] == pytest.approx(0.04)
    x, y, z = one(*shapes.earth_fixed(F.lit(0.0), F.lit(90.0), F.lit(None).cast("double")))
    assert abs(x) < 1e-6 and y == pytest.approx(6378137.0) and z == 0
    east, north = one(*shapes.local_metres(F.lit(1.0), F.lit(1.0), 60.0))
    assert north == pytest.approx(111319.49, abs=0.01) and east == pytest.approx(north / 2)
    assert one(shapes.gaussian(F.lit(2.0), 1.5))[0] == pytest.approx(math.exp(-4 / 4.5))
    keys = spark.createDataFrame([(x,) for x in (0.0, 1e-300, 1.5, 2.0, float("inf"), -1.0, float("nan"), None)], "x double").select("x", shapes.bit_key("x").alias("k")).collect()
    good = [r.k for r in keys[:5]]
    assert good == sorted(good) and len(set(good)) == 5 and [r.k for r in keys[5:]] == [None] * 3


def test_median_of_rotations():
    rng = np.random.default_rng(13)

    def turn(v):
        angle = np.linalg.norm(v)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / angle
        return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k

    true = turn(np.array([0.3, -0.4, 0.5]))
    many = np.array([turn(rng.normal(0, 0.01, 3)) @ true for _ in range(31)] + [turn(rng.normal(0, 1.5, 3)) @ true for _ in range(8)])
    assert np.abs(stats.median_rotation(many) - true).max() < 0.02


def test_steps_without_the_matrix(spark):
    rng = random.Random(11)
    rows = [(m, v, float(rng.randint(1, 50))) for m in range(60) for v in range(9) if rng.random() < 0.4]
    names, p = np.arange(9), np.linspace(0.5, 1.5, 9)
    means = {m: np.mean([x for k, _, x in rows if k == m]) for m, _, _ in rows}
    dense = spark.createDataFrame([(m, v, float(means[m]), float(p[v]), float(x - means[m] * p[v])) for m, v, x in rows], "landmark long, view long, a double, b double, r double")
    want = scene.solved(*scene.eliminated(dense, 0.01))
    blocks = scene.packed(spark.createDataFrame(rows, "landmark long, view long, value double"), names, rows=16)
    assert np.allclose(scene.reduced_step(blocks, p, 0.01), [want[v] for v in range(9)], rtol=1e-6, atol=1e-9)


def test_factorised_views_settle(spark, sf, monkeypatch):
    from tesselace.plans import registry

    kept = {}
    whole = scene.factorised
    monkeypatch.setattr(scene, "factorised", lambda *a, **k: kept.setdefault("got", whole(*a, **k)))
    monkeypatch.setattr(scene, "solved", None)  # no matrix of all views at the driver
    registry.queries()["factorised_views"](spark, sf)
    costs = kept["got"][2]
    assert costs[-2] - costs[-1] <= 1e-10 * costs[-2]


def test_nearest_triangles_keep_to_few(spark, monkeypatch):
    """Large triangles through one another: a search by boxes meets nearly all pairs."""
    rng = random.Random(12)
    whole = lambda: rng.randint(-40, 40)
    tri = [(k, *(whole() for _ in range(9))) for k in range(400)] + [(900, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    pts = [(k, whole(), whole(), whole()) for k in range(60)] + [(60, 1, 1, 1), (61, 1, 1, 1)]
    t = spark.createDataFrame(tri, "id long, " + ", ".join(f"{c} long" for c in surface.CORNERS))
    p = spark.createDataFrame([*pts, (62, None, 1, 1)], "id long, x long, y long, z long")
    both = p.join(t.withColumnRenamed("id", "triangle"))
    best = surface.closest_points(both).where("d2 is not null").groupBy("id").agg(F.min(F.struct("d2", "triangle")).alias("b"))
    want = {r.id: (r.b.triangle, r.b.d2) for r in best.collect()} | {62: (None, None)}
    for most in (10_000, 100):
        assert {r.id: (r.triangle, r.d2) for r in surface.nearest_triangles(p, t, 12.0, most).collect()} == want
    corners, places = (np.random.default_rng(13).normal(0, 15, (k, n)) for k, n in ((9, 3000), (3, 800)))
    calls, exact = [], surface.closest_weights
    monkeypatch.setattr(surface, "closest_weights", lambda p, t: calls.append(t.shape[1]) or exact(p, t))
    surface.search(places, *surface.with_bounds(np.arange(3000), corners))
    assert sum(calls) < 0.45 * 3000 * 800


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_rasters_by_pieces(spark, piece):
    rng = random.Random(14)
    for kind, draw in (("long", lambda: rng.randint(-4, 24)), ("double", lambda: rng.uniform(-4, 24))):
        tri = [(*(draw() for _ in range(6)), None if k % 6 == 0 else k) for k in range(25)] + [(*[type(draw())(3)] * 6, 5), (*[None] * 6, 5)]
        frame = spark.createDataFrame(tri, ", ".join(f"{c}{k} {kind}" for c in "abc" for k in "xy") + ", v long")
        spots = spark.range(20).select(F.col("id").alias("px")).join(spark.range(15).select(F.col("id").alias("py")))
        d2 = shapes.flat_triangle_distance2([F.col("px"), F.col("py")], *([F.col(f"{c}{k}") for k in "xy"] for c in "abc"))
        want = frame.dropna(subset=["ax"]).join(spots).where(d2 < 0.25).groupBy("px", "py").agg(F.count(F.lit(1)), F.sum("v"))
        assert sorted(map(repr, map(tuple, surface.rastered(frame, 20, 15, "v", piece=piece).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_nearest_in_a_crowd(spark):
    """Many points in one cell, copies of places, far queries and nulls; a query meets few points."""
    from tesselace.operators import nearest as module

    rng = random.Random(15)
    at = lambda n: tuple(rng.randint(0, n) for _ in range(3))
    pts = [(k, *at(40)) for k in range(1500)] + [(2000 + k, 7, 7, 7) for k in range(300)] + [(3000, None, 1, 1)]
    ask = [(k, *at(40)) for k in range(200)] + [(500 + k, 7, 7, 7) for k in range(3)] + [(600, 900, -900, 5), (601, 1, None, 1)]
    p, q = (spark.createDataFrame(x, "id long, x long, y long, z long") for x in (pts, ask))
    got = {r.id: (r.nearest, r.d2) for r in module.nearest(q, p, ["x", "y", "z"], 50).collect()}
    for k, *a in ask:
        want = (None, None) if None in a else min((sum((i - j) ** 2 for i, j in zip(a, b)), i) for i, *b in pts if None not in b)[::-1]
        assert got[k] == want
