import math

from pyspark.sql import functions as F

from tesselace.functions import geometry as g


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_camera_round_trip(spark):
    p = [2.0, 0, 5, 0, 0, 2, 6, 0, 0, 0, 1, 0]
    x, y, z = F.lit(1.0), F.lit(2.0), F.lit(4.0)
    u, v = one(spark, *g.projected(p, x, y, z))
    assert (u, v) == (5.5, 7.0)
    inverse = [0.5, 0, -2.5, 0, 0.5, -3.0, 0, 0, 1]
    size = math.sqrt(1 + 4 + 16)
    back = one(spark, *g.back_projected(inverse, [0.0, 0.0, 0.0], F.lit(u), F.lit(v), F.lit(size)))
    assert all(abs(a - b) < 1e-12 for a, b in zip(back, (1, 2, 4)))
    assert one(spark, *g.projected(p, x, y, F.lit(-1.0)))[:] == (-1.0, -1.0)


def test_masks_and_clamps(spark):
    nan = F.lit(float("nan"))
    assert one(spark, *(g.valid_depth(d) for d in (F.lit(1.0), F.lit(0.0), nan, F.lit(None).cast("double"))))[:] == (True, False, False, False)
    assert one(spark, g.face_weight(F.lit(0.25), F.lit(0.5)), g.face_weight(F.lit(-2.0), F.lit(0.5)), g.face_weight(nan, nan))[:] == (0.75, 1.0, 1.0)
    assert one(spark, g.angle_degrees(F.lit(0.0)), g.angle_degrees(F.lit(1.0000001)))[:] == (90.0, 0.0)
    assert one(spark, g.pixel(F.lit(2.5)), g.pixel(F.lit(-0.6)))[:] == (3, -1)
    assert one(spark, g.relative_error(F.lit(3.0), F.lit(0.0)))[0] == 3e6


def test_taps():
    for source, target in ((10, 4), (7, 7), (3, 9)):
        taps = g.lanczos_taps(source, target)
        assert len(taps) == target and all(abs(sum(w for _, w in t) - 1) < 1e-12 and all(0 <= k < source for k, _ in t) for t in taps)
    assert g.lanczos_taps(5, 5)[2] == [(2, 1.0)] or abs(g.lanczos_taps(5, 5)[2][2][1] - 1) < 1e-12


def test_tables_and_seeds(spark):
    from tesselace.sources.formats import looked_up

    table = F.array(*(F.lit(k / 255) for k in range(256)))
    assert one(spark, looked_up(F.array(F.lit(0), F.lit(51), F.lit(255)), table))[0] == [0.0, 0.2, 1.0]
    seeds = spark.range(100).repartition(7).select("id", g.task_seed(1, "a", F.col("id")).alias("s"), g.task_seed(1, "b", F.col("id")).alias("t"), g.task_seed(1, "a", F.col("id"), 1).alias("u"))
    rows = seeds.collect()
    assert len({x for r in rows for x in r[1:]}) == 300
    assert {r.id: r.s for r in rows} == {r.id: r.s for r in seeds.coalesce(1).collect()}
