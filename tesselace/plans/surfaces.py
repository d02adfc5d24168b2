"""Queries over triangles, cells and rasters, with their SQL.

Bindings: components 1 to 3 of an embedding are a vertex, three vectors that follow one another by id a triangle, four
a cell, and components 4 to 6 a point; all rows take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.operators import graph, surface
from tesselace.plans.base import query, read

SCALE = 100


def whole(k: int):
    return F.floor(F.col("embedding")[k].cast("double") * SCALE).cast("long")


def vertices(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(whole(k).alias(c) for k, c in enumerate("xyz")))


def points(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(whole(k + 3).alias(c) for k, c in enumerate("xyz")))


def triangles(spark, d) -> DataFrame:
    v = vertices(spark, d)
    shifted = lambda n, c: v.select((F.col("id") - n).alias("id"), *(F.col(k).alias(f"{c}{k}") for k in "xyz"))
    return shifted(0, "a").join(shifted(1, "b"), "id").join(shifted(2, "c"), "id")


def cells(spark, d) -> DataFrame:
    i = F.col("vec_id")
    return read(spark, d, "embeddings").select(i.alias("cell"), F.array(i, i + 1, i + 2, i + 3).alias("vertices"))


def at(names: str, first: int) -> str:
    return ", ".join(f"CAST(floor(CAST(embedding[{first + k}] AS DOUBLE) * {SCALE}) AS BIGINT) AS {c}" for k, c in enumerate(names))


SHAPES = f"""p AS (SELECT vec_id AS id, {at('xyz', 4)} FROM embeddings), n AS (SELECT vec_id AS id, {at('xyz', 1)} FROM embeddings),
t AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM n a JOIN n b ON b.id = a.id + 1 JOIN n c ON c.id = a.id + 2)"""


def products() -> str:
    name = lambda c, k: "by_" if (c, k) == ("b", "y") else f"{c}{k}"
    pairs = [(corner, s) for corner in "abc" for s in "bc"]
    return ", ".join(" + ".join(f"({name(s, k)} - a{k}) * ({k} - {name(corner, k)})" for k in "xyz") + f" AS e{n}" for n, (corner, s) in enumerate(pairs, 1))


CLOSEST = f"""d AS (SELECT p.id, t.id AS triangle, x, y, z, ax, ay, az, bx, by_, bz, cx, cy, cz, {products()} FROM PAIRS),
r AS (SELECT *, e1 * e4 - e3 * e2 AS vc, e5 * e2 - e1 * e6 AS vb, e3 * e6 - e5 * e4 AS va FROM d),
w AS (SELECT *, coalesce(CAST(e1 AS DOUBLE) / nullif(CAST(e1 - e3 AS DOUBLE), 0), 0) AS ab, coalesce(CAST(e2 AS DOUBLE) / nullif(CAST(e2 - e6 AS DOUBLE), 0), 0) AS ac,
  coalesce(CAST(e4 - e3 AS DOUBLE) / nullif(CAST((e4 - e3) + (e5 - e6) AS DOUBLE), 0), 0) AS bc FROM r),
g AS (SELECT *, CASE WHEN e1 <= 0 AND e2 <= 0 THEN 0 WHEN e3 >= 0 AND e4 <= e3 THEN 1 WHEN vc <= 0 AND e1 >= 0 AND e3 <= 0 THEN 2 WHEN e6 >= 0 AND e5 <= e6 THEN 3
  WHEN vb <= 0 AND e2 >= 0 AND e6 <= 0 THEN 4 WHEN va <= 0 AND e4 - e3 >= 0 AND e5 - e6 >= 0 THEN 5 ELSE 6 END AS region FROM w),
u AS (SELECT *, CASE region WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN ab WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 WHEN 5 THEN 1.0::DOUBLE - bc ELSE coalesce(CAST(vb AS DOUBLE) / nullif(CAST(va + vb + vc AS DOUBLE), 0), 0) END::DOUBLE AS v,
  CASE region WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN ac WHEN 5 THEN bc ELSE coalesce(CAST(vc AS DOUBLE) / nullif(CAST(va + vb + vc AS DOUBLE), 0), 0) END::DOUBLE AS w FROM g),
q AS (SELECT *, ax + v * (bx - ax) + w * (cx - ax) AS qx, ay + v * (by_ - ay) + w * (cy - ay) AS qy, az + v * (bz - az) + w * (cz - az) AS qz FROM u),
c AS (SELECT *, (x - qx) * (x - qx) + (y - qy) * (y - qy) + (z - qz) * (z - qz) AS d2 FROM q)"""


@query(f"WITH {SHAPES}, {CLOSEST.replace('PAIRS', 'p JOIN t ON p.id = t.id')} SELECT id, v, w, d2 FROM c")
def closest_on_triangle(spark, d):
    both = points(spark, d).join(triangles(spark, d), "id")
    return surface.closest_points(both).select("id", "v", "w", "d2")


NEAREST = f"WITH {SHAPES}, {CLOSEST.replace('PAIRS', 'p, t')}, b AS (SELECT id, triangle, d2, row_number() OVER (PARTITION BY id ORDER BY d2, triangle) AS k FROM c), near AS (SELECT id, triangle, d2 FROM b WHERE k = 1)"


def nearest(spark, d) -> DataFrame:
    return surface.nearest_triangles(points(spark, d), triangles(spark, d), 12.0)


@query(NEAREST + " SELECT id, triangle, d2 FROM near")
def triangle_nearest(spark, d):
    return nearest(spark, d).select("id", "triangle", "d2")


def between(p: int) -> str:
    return f"l[(n - 1) * {p} // 100 + 1] * (100 - (n - 1) * {p} % 100) + l[least((n - 1) * {p} // 100 + 2, n)] * ((n - 1) * {p} % 100) AS p{p}"


@query(NEAREST + f""", s AS (SELECT CAST(floor(d2 * 1000) AS BIGINT) AS m FROM near), o AS (SELECT CAST(count(*) AS BIGINT) AS n, list_sort(list(m)) AS l, CAST(sum(m) AS BIGINT) / count(*) AS mean, max(m) AS max,
CAST(sum(CASE WHEN m > 60000 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS beyond, CAST(sum(CASE WHEN m <= 15000 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS within FROM s)
SELECT n, mean, max, beyond, within, {between(50)}, {between(95)}, {between(99)} FROM o""")
def surface_distances(spark, d):
    m = nearest(spark, d).select("id", F.floor(F.col("d2") * 1000).cast("long").alias("m"))
    return surface.distance_summary(m, "m", ["id"], 60000, 15000)


AREA = f"""w AS (SELECT id, CAST(floor(sqrt(CAST(nx * nx + ny * ny + nz * nz AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT id, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx,
(bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM t))"""


@query(f"""WITH {SHAPES}, {AREA}, l AS (SELECT id, weight, coalesce(sum(weight) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w WHERE weight > 0),
s AS (SELECT vec_id AS sample, (vec_id * 2654435761) % (SELECT CAST(sum(weight) AS BIGINT) FROM w) AS a FROM embeddings)
SELECT sample, id FROM s JOIN l ON a >= start AND a < start + weight""")
def area_samples(spark, d):
    a, b, c = (surface.corner(k) for k in "abc")
    w = triangles(spark, d).select("id", F.floor(surface.doubled_area(a, b, c)).cast("long").alias("weight"))
    total = w.agg(F.sum("weight")).first()[0] or 1
    spots = read(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("vec_id") * 2654435761 % total).alias("at"))
    return surface.sampled(w, spots, max(1, total // 64))


@query("""WITH c AS (SELECT vec_id AS cell, [vec_id, vec_id + 1, vec_id + 2, vec_id + 3] AS v FROM embeddings),
f AS (SELECT cell, list_sort(list_concat(v[1:k - 1], v[k + 1:4])) AS facet FROM c, range(1, 5) t(k))
SELECT a.cell AS low, b.cell AS high, array_to_string(a.facet, ' ') AS facet FROM f a JOIN f b ON a.facet = b.facet AND a.cell < b.cell""")
def interior_facets(spark, d):
    return surface.shared_facets(cells(spark, d)).select("low", "high", F.array_join(F.transform("facet", lambda x: x.cast("string")), " ").alias("facet"))


@query("""WITH c AS (SELECT vec_id AS cell, [vec_id, vec_id + 1, vec_id + 2, vec_id + 3] AS v FROM embeddings), e AS (SELECT cell, unnest(v) AS vertex FROM c),
p AS (SELECT vec_id AS a, vec_id + 1 + vec_id % 4 AS b FROM embeddings)
SELECT a, b, CAST(count(x.cell) AS BIGINT) AS shared FROM p LEFT JOIN (SELECT l.vertex AS va, r.vertex AS vb, l.cell FROM e l JOIN e r ON l.cell = r.cell) x ON x.va = p.a AND x.vb = p.b GROUP BY a, b""")
def shared_cells(spark, d):
    i = F.col("vec_id")
    return surface.share_a_cell(read(spark, d, "embeddings").select(i.alias("a"), (i + 1 + i % 4).alias("b")), cells(spark, d))


def flat() -> str:
    side = lambda x, y: f"least(greatest(coalesce(CAST((({y[0]}) - ({x[0]})) * (px - ({x[0]})) + (({y[1]}) - ({x[1]})) * (py - ({x[1]})) AS DOUBLE) / nullif(CAST((({y[0]}) - ({x[0]})) * (({y[0]}) - ({x[0]})) + (({y[1]}) - ({x[1]})) * (({y[1]}) - ({x[1]})) AS DOUBLE), 0), 0), 0.0), 1.0)"
    out = []
    for k, (x, y) in enumerate(((("ax", "ay"), ("bx", "by_")), (("bx", "by_"), ("cx", "cy")), (("cx", "cy"), ("ax", "ay")))):
        out.append(f"({y[0]} - {x[0]}) * (py - {x[1]}) - ({y[1]} - {x[1]}) * (px - {x[0]}) AS k{k}, {side(x, y)}::DOUBLE AS t{k}")
    return ", ".join(out)


def ways() -> str:
    return ", ".join(
        f"((px - {x[0]}) - t{k} * ({y[0]} - {x[0]})) * ((px - {x[0]}) - t{k} * ({y[0]} - {x[0]})) + ((py - {x[1]}) - t{k} * ({y[1]} - {x[1]})) * ((py - {x[1]}) - t{k} * ({y[1]} - {x[1]}))"
        for k, (x, y) in enumerate(((("ax", "ay"), ("bx", "by_")), (("bx", "by_"), ("cx", "cy")), (("cx", "cy"), ("ax", "ay"))))
    )


HALVED = ", ".join(f"CAST(floor({c} / 2.0) AS BIGINT) + 20 AS {c}" for c in ("ax", "ay", "bx", "by_", "cx", "cy"))


@query(f"""WITH {SHAPES}, f AS (SELECT id, {HALVED} FROM t),
i AS (SELECT f.*, px, py FROM f, range(0, 40) u(px), range(0, 40) v(py) WHERE px BETWEEN least(ax, bx, cx) - 1 AND greatest(ax, bx, cx) + 1 AND py BETWEEN least(ay, by_, cy) - 1 AND greatest(ay, by_, cy) + 1),
k AS (SELECT *, {flat()} FROM i),
s AS (SELECT *, CASE WHEN (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) <> 0 AND ((k0 >= 0 AND k1 >= 0 AND k2 >= 0) OR (k0 <= 0 AND k1 <= 0 AND k2 <= 0)) THEN 0.0 ELSE least({ways()}) END AS d2 FROM k)
SELECT px, py, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS total FROM s WHERE d2 < 0.25 GROUP BY px, py""")
def triangle_raster(spark, d):
    half = lambda c: F.floor(F.col(c) / 2).cast("long") + 20
    t = triangles(spark, d).select("id", *(half(f"{c}{k}").alias(f"{c}{k}") for c in "abc" for k in "xy"))
    return surface.rastered(t, 40, 40, "id")


MESH = """m AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS a, l_suppkey AS b, l_partkey + l_linenumber AS c FROM lineitem),
s AS (SELECT greatest(a, b) AS high, least(a, b) AS low, id AS triangle FROM m UNION ALL SELECT greatest(b, c), least(b, c), id FROM m UNION ALL SELECT greatest(c, a), least(c, a), id FROM m)"""


@query(f"""WITH {MESH}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY high, low, triangle) - 1 AS BIGINT) AS "at" FROM s)
SELECT high, low, triangle, "at", min("at") OVER (PARTITION BY high, low) AS first, CAST(count(*) OVER (PARTITION BY high, low) AS BIGINT) AS size FROM n""")
def edge_ranges(spark, d):
    x = read(spark, d, "lineitem")
    m = x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_partkey") + F.col("l_linenumber")).alias("c"))
    return graph.edge_groups(m)
