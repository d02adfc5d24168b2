"""Sinks, heads and plans of images, stages, derivatives, rays and tours."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import exr, write
from tesselace.functions import duals, stages
from tesselace.operators import march
from tesselace.sources import formats, sinks


def test_heads_and_plans(spark, tmp_path):
    pixels = np.arange(33 * 20, dtype=np.float32).reshape(20, 33)
    for name, kind in (("a", 3), ("b", 0)):
        (tmp_path / f"{name}.exr").write_bytes(exr(pixels, kind, False))
    (tmp_path / "c.exr").write_bytes(b"nothing")
    path = f"file://{tmp_path}/*.exr"
    heads = {r.file[-5:]: r for r in formats.exr_headers(spark, path).collect()}
    assert [(heads[f].width, heads[f].height, heads[f].chunks, heads[f].channels) for f in ("a.exr", "b.exr")] == [(33, 20, 2, ["Y"]), (33, 20, 20, ["Y"])]
    assert heads["c.exr"].error and heads["c.exr"].width is None
    plan = formats.exr_chunks(spark, path).orderBy("file", "chunk").collect()
    assert [(r.y, r.lines, r.unpacked) for r in plan if r.file.endswith("a.exr")] == [(0, 16, 16 * 33 * 4), (16, 4, 4 * 33 * 4)]
    data = (tmp_path / "b.exr").read_bytes()
    for r in (r for r in plan if r.file.endswith("b.exr")):
        assert np.array_equal(np.frombuffer(data[r.offset : r.offset + r.packed], "<f4"), pixels[r.y])
    images, rest = formats.exr_worthwhile(spark, path, 10)
    assert images.count() == 20 and [f[-5:] for f in rest] == ["a.exr", "c.exr"]
    images, rest = formats.exr_worthwhile(spark, path, 99)
    assert images.count() == 0 and len(rest) == 3


def test_paired_files_and_ranges(spark, tmp_path):
    for folder, files in (("x", {"1_depth.txt": "a", "2_depth.txt": "b", "3_depth.txt": "c"}), ("y", {"2_depth.txt": "b", "3_depth.txt": "C", "4_depth.txt": "d", "note": ""})):
        (tmp_path / folder).mkdir()
        for n, t in files.items():
            (tmp_path / folder / n).write_text(t)
    got = formats.paired_files(spark, f"file://{tmp_path}/x", f"file://{tmp_path}/y", r"^(\d+)_depth")
    assert {r.name: r.found for r in got.collect()} == {"1": "first", "2": "both", "3": "differ", "4": "second"}
    rows = spark.createDataFrame([(v, k) for v in (10, 5, 30, 20) for k in range(3)], "view long, k long")
    assert {r.view for r in formats.view_range(rows, "view", 1, 2).collect()} == {10, 20}
    many = formats.listed_pairs(spark, write(tmp_path, "p.txt", " ".join(map(str, range(2000)))))
    assert many.count() == 1999
    gps = spark.createDataFrame([("10, 30, 36", "S", "20, 0, 0", "E", "7", None), ("1, 0, 0", "N", "x", "W", "7", "1")], "a string, b string, c string, d string, e string, f string")
    got = gps.select(*formats.gps_position(*(F.col(c) for c in "abcdef"))).collect()
    assert tuple(got[0]) == (-10.51, 20.0, 7.0) and tuple(got[1]) == (1.0, None, -7.0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.5, None), ("a", 1.0, 7)], "name string, x double, n long")
    path = f"file://{tmp_path}/out"
    sinks.write_report(rows, rows.agg(F.sum("x").alias("x")), path, ["name", "x", "n"], ["name"])
    assert [r.value for r in spark.read.text(f"{path}/markdown").collect()] == ["| name | x | n |", "|-|-|-|", "| a | 1.0000 | 7 |", "| b | 2.5000 |  |"]
    assert spark.read.csv(f"{path}/csv", header=True).count() == 2 and spark.read.json(f"{path}/summary").first().x == 3.5
    for _ in range(2):
        sinks.append_records(rows, f"{path}/runs")
    assert spark.read.json(f"{path}/runs").count() == 4
    sinks.write_graph(spark.createDataFrame([(2, 1, 5), (1, 2, 3), (1, 3, 4)], "src long, dst long, cap long"), f"{path}/graph")
    assert [tuple(r) for r in spark.read.parquet(f"{path}/graph").select("at", "src", "dst", "partner").orderBy("at").collect()] == [(0, 1, 2, 2), (1, 1, 3, None), (2, 2, 1, 0)]
    (tmp_path / "out" / "half").mkdir()
    assert sinks.prune(spark, path, "graph|runs|csv") == ["half", "markdown", "summary"]
    assert sinks.prune(spark, f"file://{tmp_path}", "nothing") == [] and (tmp_path / "out" / "graph").exists()


def test_stages_do_not_depend_on_batches(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"))
    stage = lambda c: {"id": c["id"], "y": c["x"] ** 2}
    plain = stage({"id": np.arange(1000), "x": np.arange(1000) * 0.5})["y"]
    for n in (1, 7):
        got = {r.id: r.y for r in stages.run_stage(rows.repartition(n), stage, "id long, y double").collect()}
        assert [got[k] for k in range(1000)] == plain.tolist()
    m = stages.Matcher().build(spark.createDataFrame([(1, 0, [0, 0]), (2, 0, [9, 9])], "id long, view long, v array<int>"))
    q = spark.createDataFrame([(5, 1, [1, 0]), (6, 1, [5, 4])], "id long, view long, v array<int>")
    assert [r.q for r in m.matches(q).collect()] == [5]
    with pytest.raises(ValueError):
        m.search(q, neighbours=3)


def test_derivatives_are_those_of_differences(spark):
    rng = np.random.default_rng(1)
    n = 12
    x = np.concatenate([rng.normal(0, 0.4, (n, 3)), rng.normal(0, 0.3, (n, 3)), rng.normal(0, 1, (n, 2)), rng.uniform(3, 6, (n, 1)), np.tile([500, 320, 240, 0.05, -0.01, 1e-3, -2e-3], (n, 1))], 1)
    x[0, :3] = 0
    x[1, :3] = 1e-6

    def values(x):
        columns = {"pose": x[:, :6], "point": x[:, 6:9], "camera": x[:, 9:], "pixel": np.zeros((n, 2))}
        return duals.projection_cost(columns)

    residual, jacobian = values(x)
    for k in range(16):
        step = np.zeros(16)
        step[k] = 1e-6
        want = (values(x + step)[0] - values(x - step)[0]) / 2e-6
        assert np.allclose(jacobian[:, :, k], want, rtol=1e-5, atol=1e-3), k
    turn = x[5, :3]
    angle = np.linalg.norm(turn)
    k = np.array([[0, -turn[2], turn[1]], [turn[2], 0, -turn[0]], [-turn[1], turn[0], 0]]) / angle
    p = (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k) @ x[5, 6:9] + x[5, 3:6]
    u, v = p[0] / p[2], p[1] / p[2]
    r2 = u * u + v * v
    assert residual[5, 0] == pytest.approx(500 * (u * (1 + r2 * (0.05 - 0.01 * r2)) + 2e-3 * u * v - 2e-3 * (r2 + 2 * u * u)) + 320)
    rows = spark.createDataFrame([(i, r[:6].tolist(), r[6:9].tolist(), r[9:].tolist(), [0.0, 0.0]) for i, r in enumerate(x)], "id long, pose array<double>, point array<double>, camera array<double>, pixel array<double>")
    got = {r.id: r for r in stages.cost_rows(rows, duals.projection_cost, ["id"]).collect()}
    assert all(np.allclose(got[i].residual, residual[i]) and np.allclose(np.array(got[i].jacobian).reshape(2, 16), jacobian[i]) for i in range(n))


def cube_mesh(n):
    """A block of n^3 cubes, each of six tetrahedra."""
    at = lambda x, y, z: (x * (n + 1) + y) * (n + 1) + z
    vertices = [(float(x), float(y), float(z)) for x, y, z in itertools.product(range(n + 1), repeat=3)]
    cells = []
    for x, y, z in itertools.product(range(n), repeat=3):
        for order in itertools.permutations(range(3)):
            p, path = [x, y, z], [at(x, y, z)]
            for k in order:
                p[k] += 1
                path.append(at(*p))
            cells.append(path)
    return vertices, cells


def test_rays_pass_all_cells(spark):
    vertices, cells = cube_mesh(3)
    mesh = march.Mesh(np.array(vertices), np.array(cells))
    rng = np.random.default_rng(2)
    rays = [(k, *rng.uniform(0.05, 2.95, 3).tolist(), *rng.uniform(0.05, 2.95, 3).tolist()) for k in range(40)]
    rays += [(40, -1.0, 1.13, 1.41, 4.0, 1.71, 1.89), (41, 5.0, 5.0, 5.0, 6.0, 6.0, 6.0), (42, 0.4, 0.3, 0.2, 9.0, 0.31, 0.24)]
    v = spark.createDataFrame([(100 + k, *p) for k, p in enumerate(vertices)], "id long, x double, y double, z double")
    c = spark.createDataFrame([(7 * k, [100 + i for i in p]) for k, p in enumerate(cells)], "cell long, vertices array<long>")
    frame = spark.createDataFrame([*rays, (43, None, *[0.0] * 5)], "ray long, sx double, sy double, sz double, ex double, ey double, ez double")
    got = {}
    for r in march.crossed_cells(frame, v, c).orderBy("ray", "at").collect():
        got.setdefault(r.ray, []).append((r.cell // 7, r.share))
    for k, *p in rays[:40]:
        start, end = np.array(p[:3]), np.array(p[3:])
        assert sum(s for _, s in got[k]) == pytest.approx(1.0)
        seen = {mesh.holding(start + t * (end - start)) for t in np.linspace(0, 1, 400)}
        assert seen <= {cell for cell, _ in got[k]}
        t = 0.0
        for cell, share in got[k]:
            middle = start + (t + share / 2) * (end - start)
            assert ((mesh.normal[cell] * middle).sum(1) <= mesh.offset[cell] + 1e-6).all()
            t += share
    assert sum(s for _, s in got[40]) == pytest.approx(3 / 5) and 41 not in got and 43 not in got
    assert sum(s for _, s in got[42]) == pytest.approx(2.6 / 8.6)


def test_weak_cells(spark):
    crossed = spark.createDataFrame([(1, k, k, 0.1) for k in range(8)], "ray long, at long, cell long, share double")
    scores = spark.createDataFrame([(k, 10 * k, k) for k in range(7)], "cell long, emptiness long, fullness long")
    assert tuple(march.weak_cells(crossed, scores, span=3).first()) == (1, 7, 60, 0, 0 + 1 + 2 + 3)


def test_tours(spark):
    rng = random.Random(3)
    rows = [(g, k, float(rng.randint(0, 4)), float(rng.randint(0, 4)), 0.0) for g in range(3) for k in range(15)]
    got = {}
    for r in march.tours(spark.createDataFrame([*rows, (0, 99, None, 0.0, 0.0)], "g long, id long, x double, y double, z double"), "g").orderBy("g", "at").collect():
        got.setdefault(r.g, []).append(r.id)
    for g in range(3):
        left = {k: (x, y) for h, k, x, y, _ in rows if h == g}
        here, want = left.pop(0), [0]
        while left:
            k = min(left, key=lambda k: ((left[k][0] - here[0]) ** 2 + (left[k][1] - here[1]) ** 2, k))
            here = left.pop(k)
            want.append(k)
        assert got[g] == want
