"""Queries that resample rasters, with their SQL. The raster: a user's cents by day, 30 days wide; a user is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.functions.geometry import lanczos_taps
from tesselace.operators import image
from tesselace.plans.base import query, read
from tesselace.plans.grids import GRID, TAP_ROWS, TAPS, grid

WIDTH, DAYS = 30, 30


def raster(spark, d) -> DataFrame:
    return grid(spark, d).select("y", "x", "v")


PLANE = f"""{GRID}, s AS (SELECT a.y, a.x, CAST(sum(b.v * t.w * u.w) AS BIGINT) AS total, CAST(sum(t.w * u.w) AS BIGINT) AS weight FROM g a, (VALUES {TAP_ROWS}) t(d, w), (VALUES {TAP_ROWS}) u(d, w), g b
WHERE b.y = a.y + t.d AND b.x = a.x + u.d GROUP BY a.y, a.x)"""


@query(f"WITH {PLANE} SELECT y, x, total, weight FROM s")
def gaussian_plane(spark, d):
    return image.plane_stencil(raster(spark, d), TAPS, TAPS)


MIP = f"""{PLANE}, m AS (SELECT y // 2 AS y, x // 2 AS x, total, weight FROM s WHERE y % 2 = 0 AND x % 2 = 0)"""


@query(f"WITH {MIP} SELECT y, x, total, weight FROM m")
def mip_level(spark, d):
    return image.plane_stencil(raster(spark, d), TAPS, TAPS, stride=2)


def values(taps) -> str:
    return ", ".join(f"({s}, {t}, {w})" for t, pairs in enumerate(taps) for s, w in pairs)


def resample_sql(source: str, taps_x, taps_y, name: str = "o") -> str:
    return f"""{name} AS (SELECT CAST(ty.t AS BIGINT) AS y, CAST(tx.t AS BIGINT) AS x, CAST(sum(g.v * tx.w * ty.w) AS BIGINT) AS total, CAST(sum(tx.w * ty.w) AS BIGINT) AS weight
FROM {source} g JOIN (VALUES {values(taps_x)}) tx(s, t, w) ON tx.s = g.x JOIN (VALUES {values(taps_y)}) ty(s, t, w) ON ty.s = g.y GROUP BY ALL)"""


ROWS = 64  # of the raster's rows, taps go by blocks of this height
BLOCK = "b AS (SELECT y % 64 AS y, x, CAST(sum(v) AS BIGINT) AS v FROM g GROUP BY 1, 2)"


def block(spark, d) -> DataFrame:
    """The raster's rows, added up by their place in a block of 64 rows: an image of fixed size of all rows."""
    return raster(spark, d).groupBy((F.col("y") % ROWS).alias("y"), "x").agg(F.sum("v").alias("v"))


HALF_X, HALF_Y = image.clamped_taps(WIDTH, WIDTH // 2, 2, TAPS), image.clamped_taps(ROWS, ROWS // 2, 2, TAPS)


@query(f"WITH {GRID}, {BLOCK}, {resample_sql('b', HALF_X, HALF_Y)} SELECT y, x, total, weight FROM o")
def clamped_downscale(spark, d):
    return image.resampled(block(spark, d), HALF_Y, HALF_X)


LANCZOS_X, LANCZOS_Y = image.whole_taps(lanczos_taps(WIDTH, 12)), image.whole_taps(lanczos_taps(ROWS, 24))


@query(f"WITH {GRID}, {BLOCK}, {resample_sql('b', LANCZOS_X, LANCZOS_Y)} SELECT y, x, total, weight FROM o")
def lanczos_downscale(spark, d):
    return image.resampled(block(spark, d), LANCZOS_Y, LANCZOS_X)


UP_X, UP_Y = image.doubled_taps(WIDTH // 2, WIDTH), image.doubled_taps(ROWS // 2, ROWS)


@query(f"""WITH {GRID}, {BLOCK}, {resample_sql('b', HALF_X, HALF_Y)}, c AS (SELECT y, x, total // weight AS v FROM o), {resample_sql('c', UP_X, UP_Y, 'u')}
SELECT b.y, b.x, b.v * u.weight - u.total AS detail, u.weight FROM b JOIN u ON b.y = u.y AND b.x = u.x""")
def band_of_levels(spark, d):
    """A level less the bilinear upsampling of the next one, in units of 1 / weight."""
    b = block(spark, d)
    low = image.resampled(b, HALF_Y, HALF_X).select("y", "x", image.mean_of(F.col("total"), F.col("weight")).alias("v"))
    up = image.resampled(low, UP_Y, UP_X)
    return b.join(up, ["y", "x"]).select("y", "x", (F.col("v") * F.col("weight") - F.col("total")).alias("detail"), "weight")


PLACES = "p AS (SELECT y AS ty, x AS tx, CASE WHEN (y + x) % 17 <> 0 THEN y * 16 + (x * 5) % 23 - 11 END AS sy, x * 16 + (y * 7) % 29 - 14 AS sx FROM g)"


@query(f"""WITH {GRID}, {PLACES}, t AS (SELECT ty, tx, CAST(floor(sy / 16.0) AS BIGINT) + j AS y, CAST(floor(sx / 16.0) AS BIGINT) + i AS x,
(CASE WHEN j = 1 THEN (sy % 16 + 16) % 16 ELSE 16 - (sy % 16 + 16) % 16 END) * (CASE WHEN i = 1 THEN (sx % 16 + 16) % 16 ELSE 16 - (sx % 16 + 16) % 16 END) AS w FROM p, (VALUES (0), (1)) a(j), (VALUES (0), (1)) b(i) WHERE sy IS NOT NULL),
m AS (SELECT ty, tx, sum(w * v) AS s, sum(w) AS w, first(v ORDER BY w DESC, y, x) AS near FROM t JOIN g USING (y, x) GROUP BY ty, tx)
SELECT p.ty, p.tx, CAST(CASE WHEN 5 * w > 256 THEN s WHEN near IS NOT NULL THEN near ELSE -1 END AS BIGINT) AS total, CAST(CASE WHEN 5 * w > 256 THEN w ELSE 1 END AS BIGINT) AS weight FROM p LEFT JOIN m USING (ty, tx)""")
def undistorted(spark, d):
    g = raster(spark, d)
    y, x = F.col("y"), F.col("x")
    places = g.select(y.alias("ty"), x.alias("tx"), F.when((y + x) % 17 != 0, y * 16 + (x * 5) % 23 - 11).alias("sy"), (x * 16 + (y * 7) % 29 - 14).alias("sx"))
    return image.remapped(g, places, 16, -1)


BOXES = "k AS (SELECT y AS ty, x AS tx, y * 32 + (x * 3) % 11 AS y0, y * 32 + (x * 3) % 11 + 8 + (y * 5) % 50 AS y1, x * 24 + (y * 3) % 7 AS x0, x * 24 + (y * 3) % 7 + 12 + (x * 7) % 40 AS x1 FROM g)"
SMALL = BOXES + ", p AS (SELECT ty, tx, CAST(floor((y0 + y1 - 16) / 2.0) AS BIGINT) AS sy, CAST(floor((x0 + x1 - 16) / 2.0) AS BIGINT) AS sx FROM k WHERE NOT (y1 - y0 > 16 AND x1 - x0 > 16))"


@query(f"""WITH {GRID}, {SMALL}, t AS (SELECT ty, tx, CAST(floor(sy / 16.0) AS BIGINT) + j AS y, CAST(floor(sx / 16.0) AS BIGINT) + i AS x,
(CASE WHEN j = 1 THEN (sy % 16 + 16) % 16 ELSE 16 - (sy % 16 + 16) % 16 END) * (CASE WHEN i = 1 THEN (sx % 16 + 16) % 16 ELSE 16 - (sx % 16 + 16) % 16 END) AS w FROM p, (VALUES (0), (1)) a(j), (VALUES (0), (1)) b(i)),
m AS (SELECT ty, tx, sum(w * v) AS s, sum(w) AS w, first(v ORDER BY w DESC, y, x) AS near FROM t JOIN g USING (y, x) GROUP BY ty, tx),
c AS (SELECT k.ty, k.tx, sum((least(y1, (g.y + 1) * 16) - greatest(y0, g.y * 16)) * (least(x1, (g.x + 1) * 16) - greatest(x0, g.x * 16)) * g.v) AS s, sum((least(y1, (g.y + 1) * 16) - greatest(y0, g.y * 16)) * (least(x1, (g.x + 1) * 16) - greatest(x0, g.x * 16))) AS w
  FROM k JOIN g ON g.y * 16 < y1 AND (g.y + 1) * 16 > y0 AND g.x * 16 < x1 AND (g.x + 1) * 16 > x0 WHERE y1 - y0 > 16 AND x1 - x0 > 16 GROUP BY k.ty, k.tx)
SELECT ty, tx, CAST(CASE WHEN 5 * w > 256 THEN s WHEN near IS NOT NULL THEN near ELSE -1 END AS BIGINT) AS total, CAST(CASE WHEN 5 * w > 256 THEN w ELSE 1 END AS BIGINT) AS weight FROM p LEFT JOIN m USING (ty, tx)
UNION ALL SELECT k.ty, k.tx, CAST(coalesce(s, -1) AS BIGINT), CAST(coalesce(w, 1) AS BIGINT) FROM k LEFT JOIN c USING (ty, tx) WHERE y1 - y0 > 16 AND x1 - x0 > 16""")
def area_warped(spark, d):
    g = raster(spark, d)
    y, x = F.col("y"), F.col("x")
    y0, x0 = y * 32 + (x * 3) % 11, x * 24 + (y * 3) % 7
    boxes = g.select(y.alias("ty"), x.alias("tx"), y0.alias("y0"), (y0 + 8 + (y * 5) % 50).alias("y1"), x0.alias("x0"), (x0 + 12 + (x * 7) % 40).alias("x1"))
    return image.area_warped(g, boxes, 16, -1)


@query(f"""WITH {GRID}, n AS (SELECT y, x, v FROM g), c AS (SELECT y, x, CAST(floor(x / 16.0) AS BIGINT) AS low FROM (SELECT y, x * 5 AS x, v FROM n))
SELECT y, x, least(greatest(low, 0), 28) AS col, (x - 16 * least(greatest(low, 0), 28)) / 16 AS weight FROM c""")
def bilinear_places(spark, d):
    from tesselace.functions.shapes import bilinear_weights

    g = raster(spark, d).select("y", (F.col("x") * 5).alias("x"))
    (col, _, _), _, (_, _, _), _ = bilinear_weights(F.col("x") / 16, F.lit(0.0), 30, 2)
    return g.select("y", "x", col.alias("col"), (F.col("x") / 16 - col).alias("weight"))


@query()
def path_means(spark, d):
    labels = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("label")
    b = block(spark, d).select("y", "x", "v", labels).withColumn("cost", F.abs(F.pmod(F.col("v"), F.lit(800)) - 100 * F.col("label")))
    return image.path_means(b, "y", "x", "label", "cost", 10, 120)


@query()
def padded_atlas(spark, d):
    e = read(spark, d, "events")
    cells = e.groupBy(F.col("event_type").alias("atlas"), (F.col("user_id") % 40).cast("long").alias("y"), (F.col("event_id") % 50).cast("long").alias("x")).agg(F.max(F.round(F.col("value") * 100)).cast("long").alias("v"))
    return image.padded(cells, "atlas", 40, 50, 6)
