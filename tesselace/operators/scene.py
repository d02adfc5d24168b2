"""Views, landmarks and observations: votes with a depth band, indexes, incremental upkeep, least squares by elimination."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselace.operators.order import numbered, ranked
from tesselace.operators.radius import spread_join
from tesselace.storage import discard, saved


def band_votes(target: DataFrame, others: DataFrame, reach: int, tolerance: int) -> DataFrame:
    """target cells (y, x, depth) with the number of votes and of voters: cells (voter, y, x, depth) of others at most
    `reach` away on both axes whose depth differs by less than `tolerance`.

    Each cell of the others is sent to the cells around it, so pairs meet by equality; the band is tested there."""
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    sent = others.select("voter", "y", "x", F.col("depth").alias("other"), around.alias("dy")).select("*", around.alias("dx"))
    sent = sent.select("voter", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "other")
    hit = target.join(sent, ["y", "x"]).where(F.abs(F.col("depth") - F.col("other")) < tolerance)
    votes = hit.groupBy("y", "x").agg(F.count(F.lit(1)).alias("votes"), F.countDistinct("voter").alias("voters"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return target.join(votes, ["y", "x"], "left").select("y", "x", "depth", none("votes"), none("voters"))


def inside_border(x: Column, y: Column, width: int, height: int, margin: int = 2) -> Column:
    """At least `margin` pixels from every border."""
    return x.between(margin, width - 1 - margin) & y.between(margin, height - 1 - margin)


def moved(dx: Column, dy: Column, least: float) -> Column:
    """A match moved by at least so many pixels; a negative bound lets all pass."""
    return F.lit(least < 0) | (dx * dx + dy * dy >= least * least)


def jumps(mid: Column, jump: Column, silent: Column) -> Column:
    """A weakly supported surface: mid is less than a tenth of the jump, the jump exceeds it by over 10,000 and hardly
    anything stands behind; without a jump there is none."""
    return F.coalesce((F.try_divide(mid.cast("double"), jump.cast("double")) < 0.1) & (jump - mid > 10_000) & (silent < 100), F.lit(False))


def outliers(observations: DataFrame, most: int, least: int) -> DataFrame:
    """(landmark, kept, behind, far): landmarks (observations: landmark, depth, squared residual s) with the number of
    observations that are in front of the camera and within the bound, those behind it and those beyond the bound.
    Landmarks with fewer than `least` kept observations are left out."""
    front = F.coalesce(F.col("depth") > 0, F.lit(False))
    near = F.coalesce(F.col("s") <= most * most, F.lit(False))
    count = lambda test: F.count_if(test)
    by = observations.groupBy("landmark").agg(count(front & near).alias("kept"), count(~front).alias("behind"), count(front & ~near).alias("far"))
    return by.where(F.col("kept") >= least)


def touched(observations: DataFrame, changed: DataFrame) -> DataFrame:
    """All observations of the landmarks that a changed view sees: what has to be tested again."""
    seen = observations.join(changed, "view", "left_semi").select("landmark").distinct()
    return observations.join(seen, "landmark", "left_semi")


def present(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(at, key): the different candidates that are still known, in order and numbered."""
    left = candidates.select(key).distinct().join(known.select(key).distinct(), key, "left_semi")
    return numbered(left, [key], "at")


def observed(observations: DataFrame, landmarks: DataFrame, views: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each observation (landmark, view, ..) with its landmark's, its view's and, by the view's camera, its camera's
    columns. Views and cameras are dimensions; they are joined, and broadcast where the optimiser knows them small."""
    return observations.join(landmarks, "landmark").join(views, "view").join(cameras, "camera")


def by_view(observations: DataFrame) -> DataFrame:
    """The inverted index (view, at, landmark): the different landmarks of each view, numbered in order."""
    return ranked(observations.select("view", "landmark").distinct(), ["view"], ["landmark"], "at")


def first_of_each(scored: DataFrame, key: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The n rows of highest score of each key, ties by id, with their rank from 0."""
    return ranked(scored.withColumn("__down", -F.col(score)), key, ["__down", tie], "rank").where(F.col("rank") < n).drop("__down")


def problem_rows(observations: DataFrame) -> DataFrame:
    """(at, block, first, landmark, view, value): one residual row an observation, in order of landmark and view, with
    the landmark's number and its first row."""
    rows = saved(numbered(observations.select("landmark", "view", "value"), ["landmark", "view"], "at"), "problem")
    blocks = numbered(rows.groupBy("landmark").agg(F.min("at").alias("first")), ["landmark"], "block")
    return rows.join(blocks, "landmark").select("at", "block", "first", "landmark", "view", "value")


def maintained(kept: DataFrame, added: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """kept without the keys of removed, and with added; a key that is added again has its new row."""
    gone = removed.select(*key).unionByName(added.select(*key)).distinct()
    return kept.join(gone, key, "left_anti").unionByName(added)


def upkeep_faults(kept: DataFrame, truth: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: missing, extra and stale keys of kept against truth."""
    a, b = kept.select(*key, F.col(value).alias("__a"), F.lit(1).alias("__in_a")), truth.select(*key, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    both = a.join(b, key, "full_outer")
    stale = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))
    return both.agg(F.count_if(F.col("__in_a").isNull()).alias("missing"), F.count_if(F.col("__in_b").isNull()).alias("extra"), F.count_if(stale).alias("stale"))


def partition_costs(residuals: DataFrame, key: Column, parts: int, s: str) -> DataFrame:
    """(part, cost, before): half the squared residuals of each part, and of all parts before it, in order of parts."""
    from pyspark.sql.window import Window

    by = residuals.groupBy(F.pmod(key, F.lit(parts)).alias("part")).agg(F.sum(s).alias("twice"))
    earlier = F.coalesce(F.sum("twice").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.select("part", (F.col("twice") / 2).alias("cost"), (earlier / 2).alias("before"))  # as many rows as parts


def column_scales(jacobian: DataFrame, column: str, value: str) -> DataFrame:
    """(column, norm2, scale): the squared norm of each column and 1 / (1 + norm)."""
    by = jacobian.groupBy(column).agg(F.sum(F.col(value) * F.col(value)).alias("norm2"))
    return by.withColumn("scale", 1 / (1 + F.sqrt(F.col("norm2").cast("double"))))


def vector_sums(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row of two vectors' dot product, squares, squared difference and greatest magnitudes."""
    a, b = F.col(x), F.col(y)
    return rows.agg(
        F.sum(a * b).alias("dot"),
        F.sum(a * a).alias("sq_x"),
        F.sum(b * b).alias("sq_y"),
        F.sum((a - b) * (a - b)).alias("sq_diff"),
        F.max(F.abs(a)).alias("max_x"),
        F.max(F.abs(b)).alias("max_y"),
    )


def eliminated(rows: DataFrame, damping: float) -> tuple[DataFrame, DataFrame]:
    """The reduced system of a linearised problem: rows (landmark, view, a, b, r) of J = [a in the view's column, b in
    the landmark's] and residual r, landmarks eliminated.

    Returns (i, j, h) and (i, g): the views' normal matrix (i <= j) and right side less what goes through landmarks. A
    landmark gives a pair for any two of its views, of which it has few. Damping adds that share of the diagonal."""
    own = rows.groupBy("landmark").agg((F.sum(F.col("b") * F.col("b")) * (1 + damping)).alias("h"), F.sum(F.col("b") * F.col("r")).alias("g"))
    each = rows.groupBy("landmark", "view").agg(F.sum(F.col("a") * F.col("b")).alias("w")).join(own, "landmark").where("h > 0")
    pairs = each.select("landmark", "h", F.col("view").alias("i"), F.col("w").alias("wi")).join(each.select("landmark", F.col("view").alias("j"), F.col("w").alias("wj")), "landmark").where("i <= j")
    through = pairs.select("i", "j", (-F.col("wi") * F.col("wj") / F.col("h")).alias("h"))
    direct = rows.select(F.col("view").alias("i"), F.col("view").alias("j"), (F.col("a") * F.col("a") * (1 + damping)).alias("h"))
    matrix = through.unionByName(direct).groupBy("i", "j").agg(F.sum("h").alias("h"))
    right = rows.select(F.col("view").alias("i"), (F.col("a") * F.col("r")).alias("g")).unionByName(each.select(F.col("view").alias("i"), (-F.col("w") * F.col("g") / F.col("h")).alias("g")))
    return matrix, right.groupBy("i").agg(F.sum("g").alias("g"))


def solved(matrix: DataFrame, right: DataFrame) -> dict[int, float]:
    """The views' steps: the reduced system, of as many unknowns as views, is solved at the driver."""
    m, g = matrix.toPandas(), right.toPandas()
    names = np.unique(np.concatenate([m["i"], m["j"], g["i"]]).astype(np.int64))
    at = lambda c: np.searchsorted(names, c.to_numpy(np.int64))
    full = np.zeros((len(names), len(names)))
    full[at(m["i"]), at(m["j"])] = m["h"]
    full = np.triu(full) + np.triu(full, 1).T
    side = np.zeros(len(names))
    side[at(g["i"])] = g["g"]
    return dict(zip(names.tolist(), np.linalg.lstsq(full, side, rcond=1e-12)[0].tolist(), strict=True))


#: A row of packed observations: whole landmarks, their numbers of rows, and of each row the view's place and the value.
PACKED = "landmarks binary, sizes binary, views binary, values binary, q binary"


def packed(observations: DataFrame, names: np.ndarray, rows: int = 1 << 16) -> DataFrame:
    """PACKED rows of observations (landmark, view, value) of views in names (sorted), about `rows` in each; a landmark
    is never cut. q begins as the mean of a landmark's values."""
    spark = observations.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    known = spark.sparkContext.broadcast(names)

    def block(table: pa.Table) -> pa.RecordBatch:
        marks, starts, sizes = np.unique(table["landmark"].to_numpy(), return_index=True, return_counts=True)
        values = table["value"].to_numpy()
        blobs = marks, sizes, np.searchsorted(known.value, table["view"].to_numpy()).astype(np.int32), values, np.add.reduceat(values, starts) / sizes
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["landmarks", "sizes", "views", "values", "q"])

    def pack(it):
        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                last = np.searchsorted(table["landmark"].to_numpy(), table["landmark"][-1].as_py())
                if last:
                    yield block(table.slice(0, last))
                held, n = table.slice(last).combine_chunks().to_batches(), n - last
        if n:
            yield block(pa.Table.from_batches(held))

    typed = observations.select(F.col("landmark").cast("long").alias("landmark"), F.col("view").cast("long").alias("view"), F.col("value").cast("double").alias("value"))
    dealt = typed.repartition("landmark").sortWithinPartitions("landmark", "view")
    return saved(dealt.mapInArrow(pack, PACKED), "packed")


def blocks_of(it):
    """(landmarks, rows' places in them, views, values, q) of PACKED rows."""
    for batch in it:
        for row in batch.to_pylist():
            marks, sizes = np.frombuffer(row["landmarks"], np.int64), np.frombuffer(row["sizes"], np.int64)
            yield marks, np.repeat(np.arange(len(marks)), sizes), np.frombuffer(row["views"], np.int32), np.frombuffer(row["values"]), np.frombuffer(row["q"])


def summed(blocks: DataFrame, of: Callable, shared: tuple, most_bytes: int = 1 << 28) -> np.ndarray:
    """The sum over PACKED rows of an array, of(shared, marks, at, views, values, q). Tasks send one array each; they
    are so few that all of them have at most `most_bytes`."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(shared)

    def add(it):
        total = sum((of(sent.value, *b) for b in blocks_of(it)), np.zeros(1))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, np.float64).tobytes()], pa.binary())], ["part"])

    parts = max(1, min(context.defaultParallelism, most_bytes // max(1, 16 * len(shared[0]))))
    total = sum((np.frombuffer(r.part) for r in blocks.coalesce(parts).mapInArrow(add, "part binary").collect()), np.zeros(1))
    sent.destroy()
    return total


def _sides(shared, marks, at, views, values, q):
    """Of each view the square of its column and its right side, less what goes through landmarks."""
    p, damping = shared
    a, b = q[at], p[views]
    r = values - a * b
    h, g = np.bincount(at, b * b, len(marks)) * (1 + damping), np.bincount(at, b * r, len(marks))
    back = np.divide(g, h, out=np.zeros(len(marks)), where=h > 0)
    own = np.bincount(views, a * a, len(p)) * (1 + damping)
    return np.concatenate([own, np.bincount(views, a * (r - b * back[at]), len(p))])


def _through(shared, marks, at, views, values, q):
    """What the landmarks take from the product of the reduced matrix with x."""
    p, x, damping = shared
    a, b = q[at], p[views]
    w, h = a * b, np.bincount(at, b * b, len(marks)) * (1 + damping)
    back = np.divide(np.bincount(at, w * x[views], len(marks)), h, out=np.zeros(len(marks)), where=h > 0)
    return np.bincount(views, w * back[at], len(p))


def _moved(p, dp, damping, marks, at, views, values, q) -> np.ndarray:
    """The landmarks' steps that belong to the views' steps dp."""
    a, b = q[at], p[views]
    h = np.bincount(at, b * b, len(marks)) * (1 + damping)
    return np.divide(np.bincount(at, b * (values - a * b - a * dp[views]), len(marks)), h, out=np.zeros(len(marks)), where=h > 0)


SHARES = (1.0, 0.5, 0.25)


def _costs(shared, marks, at, views, values, q):
    """The costs of the whole step and of parts of it; the cost without a step comes last."""
    p, dp, damping = shared
    dq = _moved(p, dp, damping, marks, at, views, values, q)
    return np.array([np.sum((values - (p + s * dp)[views] * (q + s * dq)[at]) ** 2) for s in (*SHARES, 0.0)])


def reduced_step(blocks: DataFrame, p: np.ndarray, damping: float, settle: float = 1e-8) -> np.ndarray:
    """The views' steps by conjugate gradients: the reduced matrix is never formed, each product is a pass over the
    observations."""
    own, right = summed(blocks, _sides, (p, damping)).reshape(2, -1)
    scale = np.divide(1.0, own, out=np.zeros(len(p)), where=own > 0)
    x, left = np.zeros(len(p)), right * (own > 0)
    along = z = scale * left
    size = first = float(left @ z)
    for _ in range(len(p)):
        if not size > settle * settle * first:
            break
        product = own * along - summed(blocks, _through, (p, along, damping))
        bend = float(along @ product)
        if not bend > 0:
            break
        x, left = x + size / bend * along, left - size / bend * product
        z = scale * left
        size, before = float(left @ z), size
        along = z + size / before * along
    return x


def factorised(observations: DataFrame, rounds: int | None = None, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame, list[float]]:
    """Scales p of views and q of landmarks with p * q nearest to the observations (landmark, view, value), by damped
    Gauss-Newton steps (Levenberg-Marquardt): landmarks are eliminated, steps that do not lower the cost are taken back
    and damped more, a step that overshoots is tried at half its length. Returns (view, p), (landmark, q), costs.

    Goes on until a step gains less than the tolerance, or for so many rounds. Vectors over the views fit the driver,
    their matrix need not; landmarks stay distributed. Rows with a null take no part."""
    spark = observations.sparkSession
    rows = observations.where("landmark is not null and view is not null and value is not null")
    names = np.sort(rows.select(F.col("view").cast("long").alias("view")).distinct().toArrow()["view"].to_numpy())
    p, blocks = np.ones(len(names)), packed(rows, names)
    costs, damping, k = [], 1e-3, 0
    while rounds is None or k < rounds:
        k += 1
        dp = reduced_step(blocks, p, damping)
        *tried, cost = summed(blocks, _costs, (p, dp, damping)).tolist() if len(names) else (0.0,) * (len(SHARES) + 1)
        costs = costs or [cost]
        best = next((n for n, c in enumerate(tried) if c < costs[-1]), None)
        if best is None:
            damping *= 10
            if damping > 1e8:
                break
            continue
        sent = spark.sparkContext.broadcast((p, dp, damping, SHARES[best]))

        def move(it, sent=sent):
            p, dp, damping, share = sent.value
            for batch in it:
                q = [(b[-1] + share * _moved(p, dp, damping, *b)).tobytes() for b in blocks_of([batch])]
                yield batch.set_column(4, "q", pa.array(q, pa.binary()))

        old, blocks = blocks, saved(blocks.mapInArrow(move, PACKED), "packed")
        discard(old)
        p, damping = p + SHARES[best] * dp, max(damping / 10, 1e-12)
        costs.append(tried[best])
        if costs[-2] - costs[-1] <= tolerance * max(costs[-2], 1e-300):
            break

    def marks(it):
        for b in blocks_of(it):
            yield pa.RecordBatch.from_arrays([pa.array(b[0]), pa.array(b[-1])], ["landmark", "q"])

    views = spark.createDataFrame(pa.table({"view": pa.array(names, pa.int64()), "p": pa.array(p, pa.float64())}))
    return views, blocks.mapInArrow(marks, "landmark long, q double"), costs


def run_pairs(runs: DataFrame) -> DataFrame:
    """(leg_a, run_a, leg_b, run_b, kind): all pairs of runs (leg, run), each once, within a leg and across legs.
    Runs are few: a leg is an arm of an experiment."""
    a, b = (runs.select(F.col("leg").alias(f"leg_{s}"), F.col("run").alias(f"run_{s}")) for s in "ab")
    first = F.struct("leg_a", "run_a") < F.struct("leg_b", "run_b")
    return a.join(b, first).withColumn("kind", F.when(F.col("leg_a") == F.col("leg_b"), "within").otherwise("across"))


def common_keys(a: DataFrame, b: DataFrame, group: str, key: str, least: int = 3) -> DataFrame:
    """Rows of a and b of the same group and key, of groups with at least `least` keys in common."""
    shared = a.select(group, key).distinct().join(b.select(group, key).distinct(), [group, key])
    enough = shared.groupBy(group).agg(F.countDistinct(key).alias("__n")).where(F.col("__n") >= least).select(group)
    return spread_join(a.join(enough, group, "left_semi"), b, [group, key])


def smaller_near(points: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    """(id, smaller): whether a point has, among the partners of pairs (a, b), one of a smaller score (ties: lower id)."""
    of = lambda c: points.select(F.col("id").alias(c), F.col(score).alias(f"score_{c}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    loser = F.when(F.struct("score_a", "a") < F.struct("score_b", "b"), F.col("b")).otherwise(F.col("a"))
    beaten = both.select(loser.alias("id")).distinct().withColumn("smaller", F.lit(True))
    return points.select("id").join(beaten, "id", "left").select("id", F.coalesce("smaller", F.lit(False)).alias("smaller"))


def ray_votes(crossed: DataFrame, cell: str, ray: str, at: str, weight: str) -> DataFrame:
    """(cell, emptiness, fullness, pin): crossed has a row for each cell that a ray passes, in order `at`. All but the
    last cell of a ray gain emptiness; the last gains fullness; the first one's weight pins it to the source (max)."""
    ends = crossed.groupBy(ray).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    rows = crossed.join(ends, ray)
    last, first, w = F.col(at) == F.col("__last"), F.col(at) == F.col("__first"), F.col(weight)
    zero = F.lit(0)
    return rows.groupBy(cell).agg(F.sum(F.when(last, zero).otherwise(w)).alias("emptiness"), F.sum(F.when(last, w).otherwise(zero)).alias("fullness"), F.max(F.when(first, w).otherwise(zero)).alias("pin"))


def homographies(matches: DataFrame, group: str, tries: int = 256, batch: int = 64, seed: int = 1, log_alpha: float | None = None, area: float = 1e6) -> DataFrame:
    """(group, n, inliers, log_nfa, model): for each group of matches (x, y, u, v) the plane-to-plane map of least
    a-contrario score among `tries` samples of four matches.

    A sample's seed is a hash of its group and number, so results do not depend on `batch`, the number of samples that
    are solved and scored at a time. Before residuals are sorted, a histogram bounds the score that a model can reach;
    models that cannot beat the best one so far are skipped. A group (matches of one pair of views) is one task's."""
    alpha = float(np.log(np.pi / area)) if log_alpha is None else log_alpha

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        frame = frame.sort_values(["x", "y", "u", "v"], kind="stable")
        p, q, n = frame[["x", "y"]].to_numpy(float), frame[["u", "v"]].to_numpy(float), len(frame)
        best, inliers, model = float("inf"), 0, None
        if n > 4:
            logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
            k = np.arange(5, n + 1)
            base = (logs[n] - logs[k] - logs[n - k]) + (logs[k] - logs[4] - logs[k - 4])
            rngs = (np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}/{key[0]}/{t}")) for t in range(tries))
            for _ in range(-(-tries // batch)):
                picks = np.array([g.choice(n, 4, replace=False) for g, _ in zip(rngs, range(batch), strict=False)])
                if not len(picks):
                    break
                for h in four_point_maps(p[picks], q[picks]):
                    if h is None:
                        continue
                    at = np.c_[p, np.ones(n)] @ h.T
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r2 = ((at[:, :2] / at[:, 2:] - q) ** 2).sum(1)
                    r2 = np.where(np.isfinite(r2), np.maximum(r2, 1e-12), np.inf)
                    if least_score(r2, base, k, alpha) >= best:
                        continue
                    ordered = np.sort(r2)
                    with np.errstate(invalid="ignore"):
                        scores = base + (k - 4) * (alpha + np.log(ordered[k - 1]))
                    i = int(np.argmin(scores))
                    if scores[i] < best:
                        best, inliers, model = float(scores[i]), int(k[i]), h
        return pd.DataFrame({group: [key[0]], "n": [n], "inliers": [inliers], "log_nfa": [best if model is not None else None], "model": [model.ravel().tolist() if model is not None else None]})

    kind = dict(matches.dtypes)[group]
    return matches.groupBy(group).applyInPandas(solve, f"{group} {kind}, n long, inliers long, log_nfa double, model array<double>")


def four_point_maps(p: np.ndarray, q: np.ndarray) -> list:
    """Maps of the plane through four matches each (batch, 4, 2): the null vectors of all systems by one batched SVD;
    None where four points do not fix a map."""
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)], 2).reshape(len(p), 8, 9)
    _, s, vt = np.linalg.svd(rows)
    return [h.reshape(3, 3) if ok else None for h, ok in zip(vt[:, 8], s[:, 7] > 1e-9 * s[:, 0], strict=True)]


def least_score(r2: np.ndarray, base: np.ndarray, k: np.ndarray, alpha: float, bins: int = 64) -> float:
    """A bound below any score of these residuals: each takes the lower edge of its bin of a logarithmic histogram."""
    finite = r2[np.isfinite(r2)]
    if not len(finite):
        return float("inf")
    low = np.log(finite)
    edges = np.linspace(low.min(), low.max() + 1e-9, bins + 1)
    counts = np.histogram(low, edges)[0]
    at = np.repeat(edges[:-1], counts)
    at = np.r_[at, np.full(len(r2) - len(at), np.inf)]
    with np.errstate(invalid="ignore"):
        return float(np.min(base + (k - 4) * (alpha + at[k - 1])))
