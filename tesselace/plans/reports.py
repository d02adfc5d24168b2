"""Queries that compare tables and report, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselace.operators import stats
from tesselace.operators.order import ranked
from tesselace.plans.base import query, read

CENTS = "CAST(round({} * 100) AS BIGINT)"
MAPS = f"""a AS (SELECT l_suppkey AS view, l_orderkey AS y, l_linenumber AS x, {CENTS.format('l_extendedprice')} AS v FROM lineitem WHERE l_orderkey % 11 <> 0),
b AS (SELECT l_suppkey AS view, l_orderkey AS y, l_linenumber AS x, {CENTS.format('l_extendedprice')} + l_orderkey % 13 * 100 AS v FROM lineitem WHERE l_orderkey % 7 <> 0),
j AS (SELECT view, a.v AS va, b.v AS vb FROM a FULL JOIN b USING (view, y, x))"""


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def maps(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), cents("l_extendedprice").alias("v"))
    return stats.compared(x.where("y % 11 <> 0"), x.where("y % 7 <> 0").withColumn("v", F.expr("v + y % 13 * 100")), ["view", "y", "x"], "v")


@query(f"""WITH {MAPS} SELECT view, CAST(count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) AS BIGINT) AS both_n, CAST(count(*) FILTER (vb IS NULL) AS BIGINT) AS first_n,
CAST(count(*) FILTER (va IS NULL) AS BIGINT) AS second_n, CAST(max(abs(va - vb)) AS BIGINT) AS max_diff, CAST(count(*) FILTER (1000 * abs(va - vb) <= va) AS BIGINT) AS within FROM j GROUP BY view""")
def map_compare(spark, d):
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    n = lambda k: F.count_if(F.col("found") == k)
    return maps(spark, d).groupBy("view").agg(n("both").alias("both_n"), n("first").alias("first_n"), n("second").alias("second_n"), F.max(gap).alias("max_diff"), F.count_if(1000 * gap <= F.col("value_a")).alias("within"))


@query(f"""WITH {MAPS}, v AS (SELECT view, quantile_cont(CAST(abs(va - vb) AS DOUBLE), 0.5) AS median, list_sort(list(abs(va - vb)))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)] AS p95 FROM j WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY view)
SELECT quantile_cont(median, 0.5) AS median_of_medians, min(median) AS least, max(p95) AS worst, bool_and(p95 < 2000) AS accepted FROM v""")
def map_summary(spark, d):
    gap = maps(spark, d).where("found = 'both'").withColumn("gap", F.abs(F.col("value_a") - F.col("value_b")))
    middle = stats.rank_quantiles(gap, ["view"], "gap", ["y", "x"], {"median": 50}, interpolated=True)
    by = middle.select("view", (F.col("median") / 100).alias("median")).join(stats.rank_quantiles(gap, ["view"], "gap", ["y", "x"], {"p95": 95}), "view")
    return by.agg(F.percentile("median", F.lit(0.5)).alias("median_of_medians"), F.min("median").alias("least"), F.max("p95").alias("worst"), F.bool_and(F.col("p95") < 2000).alias("accepted"))


def hundredth(p: int) -> str:
    return f"l[(n - 1) * {p} // 100 + 1] * (100 - (n - 1) * {p} % 100) + l[least((n - 1) * {p} // 100 + 2, n)] * ((n - 1) * {p} % 100) AS p{p}"


@query(f"""WITH {MAPS}, e AS (SELECT view, abs(va - vb) AS g, va FROM j WHERE va IS NOT NULL AND vb IS NOT NULL),
o AS (SELECT view, CAST(count(*) AS BIGINT) AS n, list_sort(list(g)) AS l, CAST(sum(g) AS BIGINT) / count(*) AS mean, max(g) AS max, CAST(sum(CASE WHEN 200 * g <= va THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS within FROM e GROUP BY view)
SELECT view, n, mean, max, within, {hundredth(50)}, {hundredth(95)} FROM o""")
def view_errors(spark, d):
    """Mean, median and p95 (hundredths), greatest error and the share within half a percent, by view."""
    gap = maps(spark, d).where("found = 'both'").withColumn("g", F.abs(F.col("value_a") - F.col("value_b")))
    n = F.count(F.lit(1))
    by = gap.groupBy("view").agg((F.sum("g") / n).alias("mean"), F.max("g").alias("max"), (F.count_if(200 * F.col("g") <= F.col("value_a")) / n).alias("within"))
    return by.join(stats.rank_quantiles(gap, ["view"], "g", ["y", "x"], {"p50": 50, "p95": 95}, interpolated=True), "view")


FACES = "f AS (SELECT lang, md5(text) AS face FROM documents WHERE source < 'src15'), s AS (SELECT lang, md5(text) AS face FROM documents WHERE source >= 'src15')"


@query(f"WITH {FACES} SELECT lang, face, 'first' AS side FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s) UNION ALL SELECT lang, face, 'second' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)")
def multiset_diff(spark, d):
    x = read(spark, d, "documents").select("lang", F.md5("text").alias("face"), "source")
    return stats.multiset_difference(x.where("source < 'src15'").drop("source"), x.where("source >= 'src15'").drop("source"))


@query("""WITH v AS (SELECT o_orderpriority AS p, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_totalprice) AS l FROM orders GROUP BY ALL)
SELECT p, l[least(len(l), CAST(floor(0.5 * len(l)) AS BIGINT) + 1)] AS median, l[least(len(l), CAST(floor(0.99 * len(l)) AS BIGINT) + 1)] AS p99 FROM v""")
def index_quantiles(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), cents("o_totalprice").alias("c"), "o_orderkey")
    return stats.rank_quantiles(o, ["p"], "c", ["o_orderkey"], {"median": 50, "p99": 99}).drop("n")


ARMS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")


@query("SELECT o_orderpriority AS node, " + ", ".join(f"CAST(sum(CASE WHEN c_mktsegment = '{a}' THEN {CENTS.format('o_totalprice')} END) AS BIGINT) AS {a.lower()}" for a in ARMS) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pivot_times(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = j.groupBy(F.col("o_orderpriority").alias("node")).pivot("c_mktsegment", list(ARMS)).agg(F.sum(cents("o_totalprice")))
    return made.select("node", *(F.col(a).alias(a.lower()) for a in ARMS))


@query("""WITH r AS (SELECT o_orderpriority AS p, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)
SELECT p, k, CASE WHEN n = 1 THEN 'best' WHEN n = c THEN 'worst' ELSE 'median' END AS pick FROM r WHERE n IN (1, c // 2 + 1, c)""")
def picks(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k"), "o_totalprice")
    r = ranked(o, ["p"], ["o_totalprice", "k"], "n", "c")
    pick = F.when(F.col("n") == 0, "best").when(F.col("n") == F.col("c") - 1, "worst").otherwise("median")
    return r.where((F.col("n") == 0) | (F.col("n") == F.col("c") - 1) | (F.col("n") == F.floor(F.col("c") / 2))).select("p", "k", pick.alias("pick"))


@query("""WITH e AS (SELECT user_id, event_type AS t, ts, lead(event_type) OVER w AS nt, lead(ts) OVER w AS nts FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(count(*) AS BIGINT) AS stages, CAST(sum(epoch_us(nts) - epoch_us(ts)) AS BIGINT) AS micros FROM e WHERE t = 'view' AND nt = 'click' GROUP BY user_id""")
def stage_profile(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").where("event_type in ('view', 'click')")
    e = e.select("user_id", "event_type", "ts", F.lead("event_type").over(w).alias("next"), F.lead("ts").over(w).alias("closed"))
    return e.where("event_type = 'view' and next = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("stages"), F.sum(F.unix_micros(F.col("closed").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


@query("SELECT event_type AS stage, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL ORDER BY total DESC, stage LIMIT 16")
def top_stages(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum(cents("value")).alias("total")).orderBy(F.desc("total"), "stage").limit(16)


@query("SELECT user_id, arg_max(json_extract_string(props, '$.k'), event_id) AS last FROM events GROUP BY user_id")
def last_match(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by(F.regexp_extract("props", r'"k":\s*(-?\d+)', 1), "event_id").alias("last"))


@query("SELECT event_type, bool_and(regexp_matches(props, '\"k\"')) AS required, bool_or(regexp_matches(props, 'error|fatal')) AS forbidden FROM events GROUP BY event_type")
def log_rules(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.bool_and(F.col("props").rlike('"k"')).alias("required"), F.bool_or(F.col("props").rlike("error|fatal")).alias("forbidden"))


ARM = f"m AS (SELECT o_orderpriority AS arm, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS DOUBLE) AS s, CAST(sum(CAST({CENTS.format('o_totalprice')} // 100000 AS BIGINT) * ({CENTS.format('o_totalprice')} // 100000)) AS DOUBLE) AS q, CAST(sum({CENTS.format('o_totalprice')} // 100000) AS DOUBLE) AS k FROM orders GROUP BY ALL), v AS (SELECT arm, n, k / n AS mean, (q - k * k / n) / (n - 1) AS var FROM m)"


def arms(spark, d):
    k = F.floor(cents("o_totalprice") / 100000).cast("long")
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).cast("double").alias("k"), F.sum(k * k).cast("double").alias("q"))
    n = F.col("n")
    return m.select("arm", "n", (F.col("k") / n).alias("mean"), ((F.col("q") - F.col("k") * F.col("k") / n) / (n - 1)).alias("var"))


@query(f"""WITH {ARM}, w AS (SELECT a.arm AS a, b.arm AS b, a.mean - b.mean AS diff, a.var / a.n AS u, b.var / b.n AS v, a.n AS na, b.n AS nb FROM v a JOIN v b ON a.arm < b.arm)
SELECT a, b, diff / sqrt(u + v) AS t, (u + v) * (u + v) / (u * u / (na - 1) + v * v / (nb - 1)) AS df FROM w""")
def welch_pairs(spark, d):
    x = arms(spark, d)
    a, b = (x.select(*(F.col(c).alias(f"{s}_{c}") for c in x.columns)) for s in "ab")
    j = a.join(b, F.col("a_arm") < F.col("b_arm"))
    t, df = stats.welch(*(F.col(f"{s}_{c}") for s in "ab" for c in ("mean", "var", "n")))
    return j.select(F.col("a_arm").alias("a"), F.col("b_arm").alias("b"), t.alias("t"), df.alias("df"))


@query()
def welch_verdicts(spark, d):
    w = welch_pairs(spark, d).withColumn("p", stats.two_sided("t", "df"))
    return w.withColumn("verdict", stats.verdict(F.col("p"), F.col("t") < 0, F.abs("t"), 3.0))


RESIDUAL = f"r AS (SELECT l_orderkey AS landmark, l_suppkey AS view, {CENTS.format('l_discount')} * {CENTS.format('l_discount')} AS s FROM lineitem)"


@query(f"WITH {RESIDUAL} SELECT landmark, view, CAST(s AS DOUBLE) AS s, CASE WHEN s <= 16 THEN CAST(s AS DOUBLE) ELSE 8 * sqrt(CAST(s AS DOUBLE)) - 16 END AS loss FROM r")
def huber_losses(spark, d):
    s = (cents("l_discount") * cents("l_discount")).cast("double")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("landmark"), F.col("l_suppkey").alias("view"), s.alias("s")).withColumn("loss", stats.huber(F.col("s"), 4))


@query(f"""WITH {RESIDUAL}, d AS (SELECT landmark, view, CAST(s AS DOUBLE) AS s FROM r) SELECT landmark, view, CASE WHEN s > 16 THEN 4 / sqrt(s) ELSE 1.0 END::DOUBLE AS first, CASE WHEN s > 16 THEN -4 / (2 * s * sqrt(s)) ELSE 0.0 END::DOUBLE AS second FROM d""")
def huber_correctors(spark, d):
    s = (cents("l_discount") * cents("l_discount")).cast("double")
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("landmark"), F.col("l_suppkey").alias("view"), s.alias("s"))
    first, second = stats.huber_slopes(F.col("s"), 4)
    return x.select("landmark", "view", first.alias("first"), second.alias("second"))


@query(f"WITH {RESIDUAL}, k AS (SELECT * FROM r WHERE s <= 36) SELECT landmark, CAST(count(*) AS BIGINT) AS n, CAST(max(s) AS BIGINT) AS worst FROM k GROUP BY landmark HAVING count(*) >= 2")
def residual_filter(spark, d):
    s = cents("l_discount") * cents("l_discount")
    x = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("landmark"), s.alias("s")).where("s <= 36")
    return x.groupBy("landmark").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("worst")).where("n >= 2")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS landmark, l_suppkey AS view FROM lineitem)
SELECT landmark, CAST(max(view) - min(view) AS BIGINT) AS spread FROM o GROUP BY landmark HAVING max(view) - min(view) >= 20""")
def angle_filter(spark, d):
    """A landmark stays if some pair of its views is far enough apart: the widest pair decides, without a self-join."""
    x = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("landmark")).agg((F.max("l_suppkey") - F.min("l_suppkey")).alias("spread"))
    return x.where("spread >= 20")


@query()
def robust_cutoffs(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("view"), (F.col("l_discount") + F.col("l_tax")).alias("residual"))
    return stats.best_cutoff(r, "view", "residual", 7, 0.5)


@query("""WITH r AS (SELECT l_suppkey AS view, l_discount + l_tax AS r FROM lineitem WHERE l_discount + l_tax >= 0), o AS (SELECT view, greatest(r, 1e-12) AS r, CAST(row_number() OVER w AS BIGINT) AS k, count(*) OVER (PARTITION BY view) AS n FROM r WINDOW w AS (PARTITION BY view ORDER BY r)),
s AS (SELECT view, n, k, (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) + (lgamma(k + 1) - lgamma(8) - lgamma(k - 6)) + (k - 7) * (0.5 + ln(r)) AS score FROM o WHERE k > 7)
SELECT view, CAST(max(n) AS BIGINT) AS n, arg_min(k, score) AS inliers FROM s GROUP BY view""")
def robust_inliers(spark, d):
    return robust_cutoffs(spark, d).where("inliers > 0").select("view", "n", "inliers")


MOMENTS = "p AS (SELECT label, " + ", ".join(f"CAST(floor(CAST(embedding[{k}] AS DOUBLE) * 1000) AS BIGINT) AS {c}" for k, c in enumerate("xyzuvw", 1)) + " FROM embeddings)"


@query(f"WITH {MOMENTS} SELECT label, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(sum({i} * {j}) AS BIGINT) AS s_{i}{j}" for i in "xyz" for j in "uvw") + ", " + ", ".join(f"CAST(sum({i}) AS BIGINT) AS s_{i}" for i in "xyzuvw") + " FROM p GROUP BY label")
def alignment_moments(spark, d):
    """The sums that a similarity is solved from."""
    e = F.col("embedding")
    p = read(spark, d, "embeddings").select("label", *(F.floor(e[k].cast("double") * 1000).cast("long").alias(c) for k, c in enumerate("xyzuvw")))
    return stats.moments(p, "label").select("label", "n", *(f"s_{i}{j}" for i in "xyz" for j in "uvw"), *(f"s_{i}" for i in "xyzuvw"))


@query()
def aligned_runs(spark, d):
    e = F.col("embedding")
    x = read(spark, d, "embeddings").select("label", *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return stats.similarity(x.select("*", (2 * F.col("y") + 1).alias("u"), (-2 * F.col("x")).alias("v"), (2 * F.col("z") - 3).alias("w")), "label")


@query("""SELECT CAST(count(*) AS BIGINT) AS sampled, CAST(count(*) FILTER (l_tax <= l_discount) AS BIGINT) AS same FROM lineitem WHERE l_orderkey % 16 = 0""")
def sampled_check(spark, d):
    x = read(spark, d, "lineitem").where("l_orderkey % 16 = 0")
    return x.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("l_tax") <= F.col("l_discount")).alias("same"))


@query("SELECT r_regionkey, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS digest FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def ordered_digest(spark, d):
    j = read(spark, d, "region").join(read(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("digest"))


@query("""WITH s AS (SELECT text, source FROM documents) SELECT md5(text) AS file, CASE WHEN bool_or(source < 'src15') AND bool_or(source >= 'src15') THEN 'both' WHEN bool_or(source < 'src15') THEN 'first' ELSE 'second' END AS found FROM s GROUP BY text""")
def files_in_both(spark, d):
    x = read(spark, d, "documents").select(F.md5("text").alias("file"), (F.col("source") < "src15").alias("a"))
    y = x.groupBy("file").agg(F.bool_or("a").alias("a"), F.bool_or(~F.col("a")).alias("b"))
    return y.select("file", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("found"))


@query(f"""WITH b AS (SELECT min(c) AS lo, max(c) AS hi FROM (SELECT {CENTS.format('s_acctbal')} AS c FROM supplier)), c AS (SELECT {CENTS.format('c_acctbal')} AS c FROM customer)
SELECT CAST(count(*) FILTER (c BETWEEN lo AND hi) AS BIGINT) AS inside, CAST(count(*) AS BIGINT) AS n FROM c, b""")
def clipped_share(spark, d):
    b = read(spark, d, "supplier").agg(F.min(cents("s_acctbal")).alias("lo"), F.max(cents("s_acctbal")).alias("hi"))
    c = read(spark, d, "customer").select(cents("c_acctbal").alias("c"))
    return c.crossJoin(F.broadcast(b)).agg(F.count_if(F.col("c").between(F.col("lo"), F.col("hi"))).alias("inside"), F.count(F.lit(1)).alias("n"))
