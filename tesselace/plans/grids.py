"""Queries over votes, grids and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.operators import graph, raster, votes
from tesselace.operators.order import ranked, running_sums
from tesselace.plans.base import query, read

CENTS = "CAST(round({} * 100) AS BIGINT)"
GRID = f"g AS (SELECT user_id AS y, date_diff('day', TIMESTAMP '2024-01-01', ts) AS x, CAST(sum({CENTS.format('value')}) AS BIGINT) AS v FROM events GROUP BY ALL)"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def grid(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    x = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return e.groupBy(F.col("user_id").alias("y"), x.alias("x")).agg(F.sum(cents("value")).alias("v"))


@query("""WITH a AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS agree
FROM events GROUP BY ALL), w AS (SELECT *, max(agree) OVER (PARTITION BY user_id ORDER BY day) AS began FROM a)
SELECT user_id, CAST(sum(agree) AS BIGINT) AS strict, CAST(sum(began) AS BIGINT) AS cumulative FROM w GROUP BY user_id""")
def modal_votes(spark, d):
    e = read(spark, d, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    by_day = e.groupBy("user_id", "day").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    return votes.modal_counts(by_day, "user_id", "day", F.col("bought") == 1)


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS votes, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS voters FROM events GROUP BY ALL")
def vote_counts(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("votes"), F.countDistinct(F.col("ts").cast("date")).alias("voters"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS x FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, (f.x * f.k + o.value) / (f.k + 1) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, arg_max(x, k) AS mean, CAST(max(k) AS BIGINT) AS n FROM f GROUP BY user_id""")
def ordered_fold(spark, d):
    return votes.running_mean(read(spark, d, "events"), "user_id", ["event_id"], "value")


@query(f"""SELECT l_orderkey, l_linenumber, abs({CENTS.format('l_extendedprice')} - 2000000) < 3 * greatest({CENTS.format('l_quantity')}, 200000) AS votes,
abs({CENTS.format('l_extendedprice')} - 2000000) < 5 * 200000 AS contributes FROM lineitem""")
def vote_decisions(spark, d):
    x = read(spark, d, "lineitem")
    return votes.decided(x, F.abs(cents("l_extendedprice") - 2000000), cents("l_quantity"), F.lit(200000), 3, 5).select("l_orderkey", "l_linenumber", "votes", "contributes")


BANDS = """b AS (SELECT l_partkey AS texel, level, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS weighted,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem, (VALUES (0), (1), (2)) t(level) WHERE level >= l_linenumber % 3 GROUP BY ALL)"""


def bands(spark, d) -> DataFrame:
    x = read(spark, d, "lineitem").select(F.col("l_partkey").alias("texel"), (F.col("l_linenumber") % 3).alias("band"), F.col("l_quantity").cast("long").alias("w"), cents("l_extendedprice").alias("c"))
    return votes.weighted_bands(x, "texel", "band", 3, "w", "c")


@query(f"WITH {BANDS} SELECT texel, level, weighted, weight FROM b")
def weighted_raster(spark, d):
    return bands(spark, d)


@query(f"WITH {BANDS} SELECT texel, CAST(sum(weighted // weight) AS BIGINT) AS fused, CAST(count(*) AS BIGINT) AS bands FROM b GROUP BY texel")
def fused_raster(spark, d):
    return votes.fused(bands(spark, d), "texel")


TAPS = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}
TAP_ROWS = ", ".join(f"({k}, {w})" for k, w in TAPS.items())
SMOOTH = f"""{GRID}, s AS (SELECT a.y, a.x, CAST(sum(b.v * t.w) AS BIGINT) AS total, CAST(sum(t.w) AS BIGINT) AS weight
FROM g a, (VALUES {TAP_ROWS}) t(d, w), g b WHERE b.y = a.y AND b.x = a.x + t.d GROUP BY a.y, a.x)"""


@query(f"WITH {SMOOTH} SELECT y, x, total, weight FROM s")
def gaussian_stencil(spark, d):
    return raster.stencil(grid(spark, d), "y", "x", "v", TAPS)


@query(f"WITH {SMOOTH} SELECT y, CAST(x // 2 AS BIGINT) AS x, total, weight FROM s WHERE x % 2 = 0")
def downscaled(spark, d):
    return raster.downscale(grid(spark, d), "y", "x", "v", 2, TAPS)


@query(f"WITH {SMOOTH} SELECT g.y, g.x, g.v * s.weight - s.total AS detail, s.weight FROM g JOIN s USING (y, x)")
def band_detail(spark, d):
    return raster.band_difference(grid(spark, d), "y", "x", "v", TAPS)


@query(f"""WITH {GRID}, w AS (SELECT *, lag(v) OVER (PARTITION BY y ORDER BY x) AS p, lead(v) OVER (PARTITION BY y ORDER BY x) AS n FROM g)
SELECT y, x, v, CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN 2 * (n - v) WHEN n IS NULL THEN 2 * (v - p) ELSE n - p END AS slope2 FROM w""")
def central_slopes(spark, d):
    return raster.central_difference(grid(spark, d), "y", "x", "v")


@query(f"""WITH RECURSIVE {GRID}, c AS (SELECT y, x, label, abs((v % 800 + 800) % 800 - 100 * label) AS cost FROM g, range(0, 8) t(label)),
l AS (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) AS k, list(cost ORDER BY label) AS c FROM c GROUP BY y, x),
r AS (SELECT y, x, k, c AS p FROM l WHERE k = 1 UNION ALL SELECT l.y, l.x, l.k, list_transform(range(1, 9), lambda i: l.c[i] + least(r.p[i], CASE WHEN i > 1 THEN r.p[i - 1] ELSE 1000000000 END + 10,
  CASE WHEN i < 8 THEN r.p[i + 1] ELSE 1000000000 END + 10, list_min(r.p) + 120) - list_min(r.p)) FROM r JOIN l ON l.y = r.y AND l.k = r.k + 1)
SELECT y, x, CAST(i - 1 AS INTEGER) AS label, CAST(p[i] AS BIGINT) AS path_cost FROM r, range(1, 9) t(i)""")
def path_aggregation(spark, d):
    labels = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("label")
    return raster.path_costs(grid(spark, d).select("y", "x", "v", labels).withColumn("cost", F.abs(F.pmod(F.col("v"), F.lit(800)) - 100 * F.col("label"))), "y", "x", "label", "cost", 10, 120)


def edges(spark, d) -> DataFrame:
    """Edges both ways between suppliers (even numbers) and parts (odd ones), of all lines."""
    both = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("cap"))
    return both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("cap") + 1).alias("cap")))


EDGES = """f AS (SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cap FROM lineitem GROUP BY ALL), e AS (SELECT src, dst, cap FROM f UNION ALL SELECT dst, src, cap + 1 FROM f)"""


@query(f"WITH {EDGES}, n AS (SELECT src AS node, CAST(count(*) AS BIGINT) AS degree FROM e GROUP BY src) SELECT node, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, degree FROM n")
def csr_layout(spark, d):
    return graph.csr_rows(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT CAST(2 AS BIGINT) AS node, 0 AS level UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < 12)
SELECT node, min(level) AS level FROM r GROUP BY node""")
def bfs_levels(spark, d):
    return graph.levels(edges(spark, d), spark.range(1).select(F.lit(2).cast("long").alias("node")))


@query(f"WITH {EDGES} SELECT CAST(coalesce(sum(cap), 0) AS BIGINT) AS cut, CAST(count(*) AS BIGINT) AS edges FROM e WHERE src % 3 = 0 AND dst % 3 <> 0")
def cut_of_labels(spark, d):
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).distinct()
    return graph.cut_value(e, nodes.withColumn("side", (F.col("node") % 3 != 0).cast("int")))


@query(f"WITH {EDGES} SELECT a.src, a.dst, a.cap AS forward, b.cap AS backward FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mirrored_edges(spark, d):
    return graph.mirrored_once(edges(spark, d))


@query(f"""WITH {EDGES}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, cap FROM e)
SELECT a, b, CAST(min(cap) AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS copies FROM o GROUP BY a, b""")
def edge_index(spark, d):
    e = edges(spark, d)
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("cap").alias("low"), F.count(F.lit(1)).alias("copies"))


def cut_edges(spark, d) -> DataFrame:
    """Suppliers feed their parts; one problem for each last digit of a supplier's number, with a source before all its
    suppliers and a sink behind all its parts."""
    e = edges(spark, d).where("src % 2 = 0")  # the direction from suppliers to parts
    part = F.pmod(F.col("src").cast("long"), F.lit(20)).alias("component")
    inner = e.select(part, "src", "dst", "cap")
    ends = lambda s, t: e.select(part, s, t, F.lit(40).cast("long").alias("cap")).distinct()
    both = inner.unionByName(ends(F.lit(-1).cast("long").alias("src"), F.col("src").alias("dst"))).unionByName(ends(F.col("dst").alias("src"), F.lit(-2).cast("long").alias("dst")))
    return both.select("component", "src", "dst", "cap", F.lit(-1).cast("long").alias("source"), F.lit(-2).cast("long").alias("sink"))


@query()
def min_cut_components(spark, d):
    return graph.min_cut(cut_edges(spark, d))


@query()
def unstable_erase(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("landmark"), F.col("l_suppkey").alias("view")).distinct()
    return graph.pruned(x, 3, 5)


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) % 4 AS slot FROM events")
def batch_slots(spark, d):
    r = ranked(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])
    return r.select("user_id", "event_id", (F.col("rank") % 4).alias("slot"))


@query("""WITH h AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM events)
SELECT user_id, event_id, segment, CAST(sum(v) OVER (PARTITION BY user_id, segment ORDER BY event_id) AS BIGINT) AS total FROM h""")
def segmented_scan(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", cents("value").alias("v"), (F.col("event_type") == "signup").cast("long").alias("head"))
    parts = running_sums(e, ["user_id"], ["event_id"], "head", "segment")
    return running_sums(parts, ["user_id", "segment"], ["event_id"], "v", "total").select("user_id", "event_id", "segment", "total")
