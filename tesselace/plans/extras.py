"""Queries over places, lines, rays and reports, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.functions import shapes
from tesselace.operators import march
from tesselace.plans.base import query, read
from tesselace.plans.surfaces import at, points
from tesselace.sources import formats, sinks


@query("""WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey % 90 AS DOUBLE) AS d, CAST(s_suppkey % 60 AS DOUBLE) AS m, CAST(s_nationkey AS DOUBLE) AS e, s_suppkey % 2 = 0 AS south, s_suppkey % 3 = 0 AS west, s_suppkey % 5 = 0 AS below, s_suppkey % 7 <> 0 AS known FROM supplier)
SELECT id, CASE WHEN south THEN -1.0 ELSE 1.0 END::DOUBLE * (d + m / 60 + e / 3600) AS latitude, CASE WHEN west THEN -1.0 ELSE 1.0 END::DOUBLE * (m + d / 60 + e / 3600) AS longitude, CASE WHEN known THEN CASE WHEN below THEN -1.0 ELSE 1.0 END::DOUBLE * CAST(id AS DOUBLE) END AS altitude FROM s""")
def gps_positions(spark, d):
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    text = lambda *c: F.concat_ws(", ", *(x.cast("string") for x in c))
    lat, lon = text(k % 90, k % 60, F.col("s_nationkey")), text(k % 60, k % 90, F.col("s_nationkey"))
    north, east = F.when(k % 2 == 0, "S").otherwise("N"), F.when(k % 3 == 0, "W").otherwise("E")
    names = ("latitude", "longitude", "altitude")
    made = formats.gps_position(lat, north, lon, east, F.when(k % 7 != 0, k.cast("string")), F.when(k % 5 == 0, "1"))
    return s.select(k.alias("id"), *(c.alias(n) for c, n in zip(made, names, strict=True)))


@query(f"""WITH p AS (SELECT vec_id AS id, {at('xyz', 1)}, {at('uvw', 4)} FROM embeddings)
SELECT id, CAST((z - x) * v - (u - y) * w AS DOUBLE) / nullif(CAST(y * v - x * w AS DOUBLE), 0) AS t FROM p""")
def line_crossings(spark, d):
    """Where the line from (x, y) along (y, x) meets that from (z, u) along (w, v); the six first components, whole."""
    scale = lambda k: F.floor(F.col("embedding")[k].cast("double") * 100).cast("long")
    x, y, z, u, v, w = (scale(k) for k in range(6))
    t = shapes.crossing([x, y], [y, x], [z, u], [w, v])
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), t.alias("t"))


@query(f"""WITH p AS (SELECT vec_id AS id, {at('xyz', 4)} FROM embeddings) SELECT id, sqrt(((x - 10.0::DOUBLE) * (x - 10.0::DOUBLE) + (y - 20.0::DOUBLE) * (y - 20.0::DOUBLE) + (z + 500.0::DOUBLE) * (z + 500.0::DOUBLE))
 - ((x - 10.0::DOUBLE) * 1.0::DOUBLE + (y - 20.0::DOUBLE) * 0.0::DOUBLE + (z + 500.0::DOUBLE) * 0.0::DOUBLE) * ((x - 10.0::DOUBLE) * 1.0::DOUBLE + (y - 20.0::DOUBLE) * 0.0::DOUBLE + (z + 500.0::DOUBLE) * 0.0::DOUBLE)) / 800.0::DOUBLE AS size FROM p""")
def pixel_sizes(spark, d):
    p = [F.col(c) for c in "xyz"]
    return points(spark, d).select("id", shapes.pixel_size([10.0, 20.0, -500.0], [1.0, 0.0, 0.0], p, 800.0).alias("size"))


@query("""WITH v AS (SELECT l_suppkey, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS k, l_orderkey, l_linenumber FROM lineitem)
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM v WHERE k BETWEEN 3 AND 7 GROUP BY l_suppkey""")
def view_range(spark, d):
    x = formats.view_range(read(spark, d, "lineitem"), "l_suppkey", 3, 5)
    return x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 0 AS "at", '| n_name | n_regionkey |' AS value UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_name) + 1 AS BIGINT), '| ' || n_name || ' | ' || n_regionkey || ' |' FROM nation""")
def markdown_lines(spark, d):
    return sinks.markdown(read(spark, d, "nation").select("n_name", "n_regionkey"), ["n_name", "n_regionkey"], ["n_name"])


def block_mesh(spark, n: int) -> tuple[DataFrame, DataFrame]:
    """A block of n^3 unit cubes, each cut into six tetrahedra."""
    at_ = lambda x, y, z: (x * (n + 1) + y) * (n + 1) + z
    corners = [(at_(*p), *map(float, p)) for p in itertools.product(range(n + 1), repeat=3)]
    cells = []
    for p in itertools.product(range(n), repeat=3):
        for order in itertools.permutations(range(3)):
            q, path = list(p), [at_(*p)]
            for k in order:
                q[k] += 1
                path.append(at_(*q))
            cells.append((len(cells), path))
    return spark.createDataFrame(corners, "id long, x double, y double, z double"), spark.createDataFrame(cells, "cell long, vertices array<long>")


def crossed(spark, d) -> DataFrame:
    """Rays between the places of each vector, components 1 to 3 and 4 to 6, in a block of four cubes a side."""
    e = lambda k: (F.col("embedding")[k].cast("double") * 4 + 2)
    rays = read(spark, d, "embeddings").select(F.col("vec_id").alias("ray"), *(e(k).alias(c) for k, c in enumerate(("sx", "sy", "sz", "ex", "ey", "ez"))))
    return march.crossed_cells(rays, *block_mesh(spark, 4))


@query()
def rays_through_cells(spark, d):
    return crossed(spark, d)


@query()
def weak_cells(spark, d):
    from tesselace.operators.scene import ray_votes

    c = crossed(spark, d).withColumn("w", F.lit(1))
    return march.weak_cells(c, ray_votes(c, "cell", "ray", "at", "w").drop("pin"))


@query()
def camera_tours(spark, d):
    return march.tours(points(spark, d).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id"), "label")
