"""Queries over views, landmarks and observations, with their SQL.

Bindings: an order is a landmark, a supplier a view, a nation a camera, a line an observation; a user's day is a cell,
its cents a depth and an event type a voter; all rows take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.operators import graph, scene
from tesselace.operators.order import numbered
from tesselace.operators.radius import radius_pairs
from tesselace.plans.base import query, read
from tesselace.plans.grids import EDGES, cents, edges
from tesselace.plans.vectors import PAIRS, POINTS, points

CENTS = "CAST(round({} * 100) AS BIGINT)"
DAY = "date_diff('day', TIMESTAMP '2024-01-01', ts)"
CELLS = f"""c AS (SELECT event_type AS voter, user_id AS y, {DAY} AS x, CAST(sum({CENTS.format('value')}) AS BIGINT) AS depth FROM events GROUP BY ALL),
t AS (SELECT y, x, depth FROM c WHERE voter = 'view'), o AS (SELECT * FROM c WHERE voter <> 'view')"""


def cells(spark, d) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return read(spark, d, "events").groupBy(F.col("event_type").alias("voter"), F.col("user_id").alias("y"), day.alias("x")).agg(F.sum(cents("value")).alias("depth"))


@query(f"""WITH {CELLS}, h AS (SELECT t.y, t.x, o.voter FROM t JOIN o ON o.y BETWEEN t.y - 1 AND t.y + 1 AND o.x BETWEEN t.x - 1 AND t.x + 1 AND abs(t.depth - o.depth) < 3000)
SELECT t.y, t.x, t.depth, CAST(count(h.voter) AS BIGINT) AS votes, CAST(count(DISTINCT h.voter) AS BIGINT) AS voters FROM t LEFT JOIN h ON h.y = t.y AND h.x = t.x GROUP BY t.y, t.x, t.depth""")
def band_votes(spark, d):
    c = cells(spark, d)
    return scene.band_votes(c.where("voter = 'view'").select("y", "x", "depth"), c.where("voter <> 'view'"), 1, 3000)


@query(f"""WITH {CELLS} SELECT voter, y, x, (x BETWEEN 2 AND 27 AND y BETWEEN 2 AND 1000000 - 3) AS inside, (x * x + depth * depth >= 25000000) AS moved, depth <> 0 AS nonzero FROM c""")
def cell_tests(spark, d):
    x, y = F.col("x"), F.col("y")
    return cells(spark, d).select("voter", "y", "x", scene.inside_border(x, y, 30, 1_000_000).alias("inside"), scene.moved(x, F.col("depth"), 5000).alias("moved"), (F.col("depth") != 0).alias("nonzero"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN false ELSE CAST(l_quantity * 100 AS DOUBLE) / l_extendedprice < 0.1 AND l_extendedprice - l_quantity * 100 > 10000 AND l_tax * 10000 < 100 END AS jumps FROM lineitem""")
def weak_surfaces(spark, d):
    x = read(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", scene.jumps(F.col("l_quantity") * 100, F.col("l_extendedprice"), F.col("l_tax") * 10000).alias("jumps"))


OBSERVED = f"""b AS (SELECT l_orderkey AS landmark, l_suppkey AS view, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS value, {CENTS.format('l_discount')} AS r, {CENTS.format('l_tax')} AS j, l_returnflag AS flag FROM lineitem)"""


def observations(spark, d) -> DataFrame:
    x = read(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("landmark"), F.col("l_suppkey").alias("view"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("value"), cents("l_discount").alias("r"), cents("l_tax").alias("j"), F.col("l_returnflag").alias("flag"))


@query(f"""WITH {OBSERVED} SELECT landmark, CAST(count(*) FILTER (j > 0 AND r * r <= 36) AS BIGINT) AS kept, CAST(count(*) FILTER (j <= 0) AS BIGINT) AS behind, CAST(count(*) FILTER (j > 0 AND r * r > 36) AS BIGINT) AS far
FROM b GROUP BY landmark HAVING count(*) FILTER (j > 0 AND r * r <= 36) >= 2""")
def residual_outliers(spark, d):
    return scene.outliers(observations(spark, d).select("landmark", F.col("j").alias("depth"), (F.col("r") * F.col("r")).alias("s")), 6, 2)


@query(f"""WITH {OBSERVED}, c AS (SELECT s_suppkey AS view FROM supplier WHERE s_acctbal < 5000)
SELECT landmark, view, line FROM b WHERE landmark IN (SELECT landmark FROM b WHERE view IN (SELECT view FROM c))""")
def touched_observations(spark, d):
    changed = read(spark, d, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("view"))
    return scene.touched(observations(spark, d), changed).select("landmark", "view", "line")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25))
SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS "at" FROM c""")
def present_candidates(spark, d):
    known = read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return scene.present(read(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), known, "id")


@query(f"""WITH {OBSERVED} SELECT landmark, view, line, value, s_nationkey AS camera, n_regionkey AS model, {CENTS.format('o_totalprice')} AS depth
FROM b JOIN orders ON o_orderkey = landmark JOIN supplier ON s_suppkey = view JOIN nation ON n_nationkey = s_nationkey""")
def observed_landmarks(spark, d):
    landmarks = read(spark, d, "orders").select(F.col("o_orderkey").alias("landmark"), cents("o_totalprice").alias("depth"))
    views = read(spark, d, "supplier").select(F.col("s_suppkey").alias("view"), F.col("s_nationkey").alias("camera"))
    cameras = read(spark, d, "nation").select(F.col("n_nationkey").alias("camera"), F.col("n_regionkey").alias("model"))
    return scene.observed(observations(spark, d), landmarks, views, cameras).select("landmark", "view", "line", "value", "camera", "model", "depth")


@query(f"""WITH {OBSERVED}, k AS (SELECT DISTINCT view, landmark FROM b) SELECT view, landmark, CAST(row_number() OVER (PARTITION BY view ORDER BY landmark) - 1 AS BIGINT) AS "at" FROM k""")
def landmarks_by_view(spark, d):
    return scene.by_view(observations(spark, d)).select("view", "landmark", "at")


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, {CENTS.format('o_totalprice')} AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {CENTS.format('o_totalprice')} DESC, o_orderkey) - 1 AS BIGINT) AS rank FROM orders)
SELECT o_custkey, o_orderkey, score, rank FROM r WHERE rank < 3""")
def first_of_each(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("score"))
    return scene.first_of_each(o, ["o_custkey"], "score", "o_orderkey", 3)


PROBLEM = f"""{OBSERVED}, u AS (SELECT landmark, view, CAST(sum(value) AS BIGINT) AS value FROM b GROUP BY ALL)"""


@query(f"""WITH {PROBLEM}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY landmark, view) - 1 AS BIGINT) AS "at" FROM u)
SELECT "at", CAST(dense_rank() OVER (ORDER BY landmark) - 1 AS BIGINT) AS block, min("at") OVER (PARTITION BY landmark) AS first, landmark, view, value FROM n""")
def problem_rows(spark, d):
    return scene.problem_rows(observations(spark, d).groupBy("landmark", "view").agg(F.sum("value").alias("value")))


UPKEEP = f"""{OBSERVED}, old AS (SELECT landmark, line, value FROM b WHERE flag <> 'N'), gone AS (SELECT landmark, line FROM b WHERE flag = 'R'), new AS (SELECT landmark, line, value + 1 AS value FROM b WHERE flag = 'N'),
out AS (SELECT landmark, line FROM gone UNION SELECT landmark, line FROM new), kept AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM out g WHERE g.landmark = old.landmark AND g.line = old.line) UNION ALL SELECT * FROM new)"""


def upkeep(spark, d) -> tuple[DataFrame, DataFrame]:
    b = observations(spark, d)
    some = lambda test, value: b.where(test).select("landmark", "line", value.alias("value"))
    return scene.maintained(some("flag <> 'N'", F.col("value")), some("flag = 'N'", F.col("value") + 1), some("flag = 'R'", F.col("value")), ["landmark", "line"]), b


@query(f"WITH {UPKEEP} SELECT landmark, line, value FROM kept")
def maintained_rows(spark, d):
    return upkeep(spark, d)[0]


@query(f"""WITH {UPKEEP}, t AS (SELECT landmark, line, value FROM b WHERE flag <> 'A')
SELECT CAST(count(*) FILTER (k.landmark IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (t.landmark IS NULL) AS BIGINT) AS extra, CAST(count(*) FILTER (k.value <> t.value) AS BIGINT) AS stale
FROM kept k FULL JOIN t ON k.landmark = t.landmark AND k.line = t.line""")
def upkeep_faults(spark, d):
    kept, b = upkeep(spark, d)
    return scene.upkeep_faults(kept, b.where("flag <> 'A'").select("landmark", "line", "value"), ["landmark", "line"], "value")


@query(f"""WITH {OBSERVED}, p AS (SELECT landmark % 16 AS part, CAST(sum(r * r) AS BIGINT) AS twice FROM b GROUP BY 1)
SELECT part, twice / 2 AS cost, coalesce(sum(twice) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2 AS before FROM p""")
def partition_costs(spark, d):
    return scene.partition_costs(observations(spark, d).withColumn("s", F.col("r") * F.col("r")), F.col("landmark"), 16, "s")


@query(f"WITH {OBSERVED} SELECT view, CAST(sum(j * j) AS BIGINT) AS norm2, 1 / (1 + sqrt(CAST(sum(j * j) AS DOUBLE))) AS scale FROM b GROUP BY view")
def column_scales(spark, d):
    return scene.column_scales(observations(spark, d), "view", "j")


@query(f"""WITH {OBSERVED} SELECT CAST(sum(r * j) AS BIGINT) AS dot, CAST(sum(r * r) AS BIGINT) AS sq_x, CAST(sum(j * j) AS BIGINT) AS sq_y, CAST(sum((r - j) * (r - j)) AS BIGINT) AS sq_diff,
CAST(max(abs(r)) AS BIGINT) AS max_x, CAST(max(abs(j)) AS BIGINT) AS max_y FROM b""")
def vector_sums(spark, d):
    return scene.vector_sums(observations(spark, d), "r", "j")


@query(f"""WITH {OBSERVED}, o AS (SELECT landmark, sum(j * j) AS h, sum(j * r) AS g FROM b GROUP BY landmark), e AS (SELECT landmark, view, sum(value * j) AS w FROM b GROUP BY ALL)
SELECT view AS i, CAST(sum(value * value) AS BIGINT) AS direct, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY view""")
def normal_diagonal(spark, d):
    """The views' own part of the normal matrix, before landmarks are eliminated."""
    b = observations(spark, d)
    return b.groupBy(F.col("view").alias("i")).agg(F.sum(F.col("value") * F.col("value")).alias("direct"), F.count(F.lit(1)).alias("n"))


@query()
def reduced_system(spark, d):
    b = observations(spark, d).select("landmark", "view", F.col("value").cast("double").alias("a"), (F.col("j") + 1).cast("double").alias("b"), F.col("r").cast("double").alias("r"))
    matrix, right = scene.eliminated(b, 0.0)
    return matrix.join(right, "i")


@query()
def factorised_views(spark, d):
    b = observations(spark, d).groupBy("landmark", "view").agg(F.avg("value").alias("value"))
    return scene.factorised(b)[0]


@query("""WITH r AS (SELECT DISTINCT o_orderpriority AS leg, year(o_orderdate) AS run FROM orders)
SELECT a.leg AS leg_a, a.run AS run_a, b.leg AS leg_b, b.run AS run_b, CASE WHEN a.leg = b.leg THEN 'within' ELSE 'across' END AS kind FROM r a JOIN r b ON a.leg < b.leg OR (a.leg = b.leg AND a.run < b.run)""")
def run_pairs(spark, d):
    r = read(spark, d, "orders").select(F.col("o_orderpriority").alias("leg"), F.year("o_orderdate").cast("long").alias("run")).distinct()
    return scene.run_pairs(r)


@query(f"""WITH a AS (SELECT c_nationkey AS g, c_custkey AS k, {CENTS.format('c_acctbal')} AS x FROM customer), b AS (SELECT s_nationkey AS g, s_suppkey AS k, {CENTS.format('s_acctbal')} AS u FROM supplier),
j AS (SELECT g, k % 5 AS k, x FROM a), h AS (SELECT g, k % 5 AS k, u FROM b), m AS (SELECT j.g, j.k, x, u FROM j JOIN h ON j.g = h.g AND j.k = h.k)
SELECT g, k, x, u FROM m WHERE g IN (SELECT g FROM m GROUP BY g HAVING count(DISTINCT k) >= 3)""")
def common_cameras(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 5).alias("k"), cents("c_acctbal").alias("x"))
    b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 5).alias("k"), cents("s_acctbal").alias("u"))
    return scene.common_keys(a, b, "g", "k", 3)


@query(f"""WITH {POINTS}, {PAIRS}, s AS (SELECT vec_id AS id, (vec_id * 7919) % 101 AS score FROM embeddings),
w AS (SELECT a, b, x.score AS sa, y.score AS sb FROM r JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE d2 <= 1600)
SELECT id, EXISTS (SELECT 1 FROM w WHERE (b = id AND (sa < sb OR (sa = sb AND a < b))) OR (a = id AND (sb < sa OR (sa = sb AND b < a)))) AS smaller FROM s""")
def smaller_score_near(spark, d):
    p = points(spark, d).withColumn("score", F.col("id") * 7919 % 101)
    return scene.smaller_near(p, radius_pairs(p, ["x", "y", "z"], 40), "score")


@query(f"""WITH {OBSERVED}, e AS (SELECT *, min(line) OVER (PARTITION BY landmark) AS lo, max(line) OVER (PARTITION BY landmark) AS hi FROM b)
SELECT view, CAST(sum(CASE WHEN line = hi THEN 0 ELSE value END) AS BIGINT) AS emptiness, CAST(sum(CASE WHEN line = hi THEN value ELSE 0 END) AS BIGINT) AS fullness, CAST(max(CASE WHEN line = lo THEN value ELSE 0 END) AS BIGINT) AS pin FROM e GROUP BY view""")
def ray_votes(spark, d):
    return scene.ray_votes(observations(spark, d), "view", "landmark", "line", "value")


@query(f"""WITH {EDGES}, l AS (SELECT *, CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS "at" FROM e)
SELECT a."at", a.src, a.dst, a.cap, b."at" AS partner FROM l a LEFT JOIN l b ON a.src = b.dst AND a.dst = b.src""")
def csr_edges(spark, d):
    return graph.csr_edges(edges(spark, d))


PINNED = """p AS (SELECT src, dst, CASE WHEN src = 2 AND dst % 3 = 0 THEN 1073741824 WHEN dst = 5 AND src % 5 = 0 THEN 1073741824 ELSE cap END AS cap FROM e),
n AS (SELECT DISTINCT dst AS node FROM p WHERE src = 2 AND cap >= 1073741824), z AS (SELECT DISTINCT src AS node FROM p WHERE dst = 5 AND cap >= 1073741824 AND src NOT IN (SELECT node FROM n)),
m AS (SELECT CASE WHEN src IN (SELECT node FROM n) THEN 2 WHEN src IN (SELECT node FROM z) THEN 5 ELSE src END AS src, CASE WHEN dst IN (SELECT node FROM n) THEN 2 WHEN dst IN (SELECT node FROM z) THEN 5 ELSE dst END AS dst, cap FROM p)"""


@query(f"WITH {EDGES}, {PINNED} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(sum(cap) AS BIGINT) AS cap FROM m WHERE src <> dst AND dst <> 2 AND src <> 5 GROUP BY src, dst")
def contracted_graph(spark, d):
    pinned = F.when(((F.col("src") == 2) & (F.col("dst") % 3 == 0)) | ((F.col("dst") == 5) & (F.col("src") % 5 == 0)), 1 << 30).otherwise(F.col("cap"))
    return graph.contracted(edges(spark, d).withColumn("cap", pinned), 2, 5)


@query(f"""WITH {EDGES}, h AS (SELECT DISTINCT src AS node, src % 7 AS height, src % 11 AS excess FROM e),
o AS (SELECT e.src, e.dst, e.cap, a.excess, a.height, b.height AS below, row_number() OVER (PARTITION BY e.src ORDER BY b.height, e.dst, e.cap) AS k FROM e JOIN h a ON a.node = e.src JOIN h b ON b.node = e.dst WHERE a.excess > 0 AND e.cap > 0)
SELECT src AS node, dst, CAST(CASE WHEN height > below THEN least(excess, cap) ELSE 0 END AS BIGINT) AS pushed, CAST(CASE WHEN height > below THEN height ELSE below + 1 END AS BIGINT) AS height FROM o WHERE k = 1""")
def relabel_step(spark, d):
    e = edges(spark, d)
    n = e.select(F.col("src").alias("node")).distinct()
    return graph.relabelled(e.withColumnRenamed("cap", "room"), n.select("node", (F.col("node") % 7).alias("height")), n.select("node", (F.col("node") % 11).alias("excess")))


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS "at" FROM events""")
def ordering(spark, d):
    """The permutation that sorts values by their bits, which for non-negative doubles is their order."""
    from tesselace.functions.shapes import bit_key

    e = read(spark, d, "events").select("event_id", bit_key("value").alias("key"))
    return numbered(e, ["key", "event_id"], "at").select("event_id", "at")


@query("""WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS k FROM events)
SELECT a.event_id, b.event_id AS original FROM o a JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) b ON a.k = b.k""")
def permuted(spark, d):
    """Rows carried from their place to that which an ordering gives them: two numberings joined on position."""
    e = read(spark, d, "events").select("event_id", "value")
    a, b = numbered(e, ["value", "event_id"], "k"), numbered(e.select(F.col("event_id").alias("original")), ["original"], "k")
    return a.join(b, "k").select("event_id", "original")


@query()
def plane_maps(spark, d):
    """Matches between vectors of one label: plane coordinates are components 1, 2 and, with noise, a map of them."""
    e = F.col("embedding")
    at = [F.floor(e[k].cast("double") * 1000).cast("double") for k in (0, 1)]
    odd = F.when(F.col("vec_id") % 4 == 0, F.floor(e[2].cast("double") * 500)).otherwise(0).cast("double")
    m = read(spark, d, "embeddings").select("label", at[0].alias("x"), at[1].alias("y"), (2 * at[0] + 10 + odd).alias("u"), (2 * at[1] - 5 + odd).alias("v"))
    return scene.homographies(m, "label")
