"""Edge layouts, reachability and fixed points over distributed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselace.operators.order import numbered
from tesselace.storage import discard, saved


def csr_rows(edges: DataFrame) -> DataFrame:
    """(node, first, degree): where each source's edges begin when edges are laid out by source."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return numbered(degree, ["node"], "first", F.col("degree"))


def csr_edges(edges: DataFrame) -> DataFrame:
    """(at, src, dst, cap, partner): edges (src, dst, cap; no two alike) laid out by source and target, and where each
    one's reverse edge lies; null if there is none."""
    laid = saved(numbered(edges.select("src", "dst", "cap"), ["src", "dst"], "at"), "edges")
    back = laid.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("at").alias("partner"))
    return laid.join(back, ["src", "dst"], "left")


def edge_groups(triangles: DataFrame) -> DataFrame:
    """(high, low, triangle, at, first, size): the edges of triangles (id, a, b, c), one entry a triangle, in
    lexicographic order, with the range of entries of the same edge."""
    sides = F.array(*(F.struct(F.greatest(p, q).alias("high"), F.least(p, q).alias("low")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    entries = triangles.select(F.col("id").alias("triangle"), F.explode(sides).alias("e")).select("e.high", "e.low", "triangle")
    laid = saved(numbered(entries, ["high", "low", "triangle"], "at"), "sides")
    return laid.join(laid.groupBy("high", "low").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")), ["high", "low"])


def contracted(edges: DataFrame, source: int, sink: int, pinned: int = 1 << 30) -> DataFrame:
    """Edges (src, dst, cap) after nodes that the source reaches, or that reach the sink, by an edge of at least
    `pinned` became that end; parallel edges are added up, edges inside an end and into the source or out of the sink
    are left out. A node tied to both ends stays the source's."""
    near = edges.where((F.col("src") == source) & (F.col("cap") >= pinned)).select(F.col("dst").alias("node")).distinct().withColumn("end", F.lit(source))
    far = edges.where((F.col("dst") == sink) & (F.col("cap") >= pinned)).select(F.col("src").alias("node")).distinct().withColumn("end", F.lit(sink))
    ends = near.unionByName(far.join(near, "node", "left_anti"))
    for c in ("src", "dst"):
        edges = edges.join(ends.select(F.col("node").alias(c), F.col("end").cast("long").alias("__end")), c, "left").withColumn(c, F.coalesce("__end", c)).drop("__end")
    left = edges.where((F.col("src") != F.col("dst")) & (F.col("dst") != source) & (F.col("src") != sink))
    return left.groupBy("src", "dst").agg(F.sum("cap").cast("long").alias("cap"))


def relabelled(edges: DataFrame, heights: DataFrame, excess: DataFrame) -> DataFrame:
    """One step of push-relabel for all active nodes, reading only the state before it.

    edges (src, dst, room), heights (node, height), excess (node, excess). For each node with excess: the residual edge
    to its lowest neighbour (lowest target first), what is pushed along it, and its new height where it lies too low."""
    active = excess.where("excess > 0").join(heights, "node")
    open_ = edges.where("room > 0").join(active.withColumnRenamed("node", "src"), "src")
    open_ = open_.join(heights.select(F.col("node").alias("dst"), F.col("height").alias("below")), "dst")
    best = open_.groupBy("src", "excess", "height").agg(F.min(F.struct("below", "dst", "room")).alias("e"))
    down = F.col("height") > F.col("e.below")
    return best.select(
        F.col("src").alias("node"),
        F.col("e.dst").alias("dst"),
        F.when(down, F.least("excess", "e.room")).otherwise(0).cast("long").alias("pushed"),
        F.when(down, F.col("height")).otherwise(F.col("e.below") + 1).cast("long").alias("height"),
    )


def levels(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(node, level) by breadth from start (node); edges (src, dst) are followed from src to dst.

    What was reached before is compacted every eight levels, so that a round reads at most eight small tables more."""
    parts = [saved(start.select("node", F.lit(0).alias("level")).distinct())]
    front = parts[0]
    for level in range(1, most + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        reached = reduce(DataFrame.unionByName, parts)
        front = saved(step.join(reached.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return reached
        parts.append(front)
        if len(parts) > 8:
            whole = saved(reduce(DataFrame.unionByName, parts))
            for old in parts:
                discard(old)
            parts, front = [whole], whole.where(F.col("level") == level)
    raise RuntimeError(f"not settled after {most} levels")


def cut_value(edges: DataFrame, side: DataFrame) -> DataFrame:
    """Sum of capacities from the source's side (side = 0) to the sink's (side = 1)."""
    of = lambda c: side.select(F.col("node").alias(c), F.col("side").alias(f"{c}_side"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst")
    return both.where("src_side = 0 and dst_side = 1").agg(F.coalesce(F.sum("cap"), F.lit(0)).cast("long").alias("cut"), F.count(F.lit(1)).alias("edges"))


def mirrored_once(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from its lower end, with the weight of the mirror edge beside its own."""
    low = edges.where("src < dst").select("src", "dst", F.col("cap").alias("forward"))
    high = edges.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cap").alias("backward"))
    return low.join(high, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("forward", F.lit(0)).alias("forward"), F.coalesce("backward", F.lit(0)).alias("backward"))


def suppressed(nodes: DataFrame, conflicts: DataFrame, most: int = 1000) -> DataFrame:
    """(id, survives): in id order, a node is dropped if a surviving node before it is in conflict with it.

    Rounds read only what was decided before: a node survives when all earlier rivals are dropped, and is dropped
    when one of them survives. conflicts: (a, b) with a < b."""
    state = saved(nodes.select("id", F.lit(None).cast("boolean").alias("survives")))
    for _ in range(most):
        rival = conflicts.select(F.col("a").alias("id"), "b").join(state.select("id", F.col("survives").alias("rival")), "id").groupBy(F.col("b").alias("id")).agg(
            F.max(F.coalesce(F.col("rival"), F.lit(False)).cast("int")).alias("beaten"), F.sum(F.col("rival").isNull().cast("int")).alias("open")
        )
        known = state.join(rival, "id", "left").withColumn("beaten", F.coalesce("beaten", F.lit(0))).withColumn("open", F.coalesce("open", F.lit(0)))
        state = saved(known.select("id", F.coalesce("survives", F.when(F.col("beaten") == 1, False).when(F.col("open") == 0, True)).alias("survives")))
        if state.where("survives is null").isEmpty():
            return state
    raise RuntimeError("suppression did not settle")


def pruned(observations: DataFrame, least_landmark: int, least_view: int, most: int = 1000) -> DataFrame:
    """Observations (landmark, view) left when landmarks and views with too few of them are erased until none is."""
    left = saved(observations)
    n = left.count()
    for _ in range(most):
        marks = left.groupBy("landmark").count().where(F.col("count") >= least_landmark).select("landmark")
        some = left.join(marks, "landmark", "left_semi")
        views = some.groupBy("view").count().where(F.col("count") >= least_view).select("view")
        left = saved(some.join(views, "view", "left_semi").select(observations.columns))
        if (now := left.count()) == n:
            return left
        n = now
    raise RuntimeError("erasing did not settle")


KEY = ["component", "node"]
LARGE = 1 << 62


def min_cut(edges: DataFrame, **options) -> DataFrame:
    """(component, flow) of min_cut_labels."""
    small, large = by_edges(edges, **options)
    flows = solved(small).select("component", "flow").distinct()
    return flows if large is None else flows.unionByName(spread_flow(large)[0])


def min_cut_labels(edges: DataFrame, **options) -> DataFrame:
    """(component, flow, node, sink_side): minimum s-t cut of each component's graph (src, dst, cap, source, sink).

    A node is on the sink's side if the sink can be reached from it in the residual graph, which is the same for every
    maximum flow. Components of at most `task_edges` edges are each solved in one task; larger ones are solved as
    tables, by all tasks. With `most_edges`, a component of more edges than that is an error."""
    small, large = by_edges(edges, **options)
    labels = solved(small)
    if large is None:
        return labels
    flows, net, flowing = spread_flow(large)
    ends = [large.select("component", F.col(c).alias("node")) for c in ("src", "dst", "source", "sink")]
    nodes = reduce(DataFrame.unionByName, ends).distinct()
    sides = sink_sides(net, flowing, large.groupBy("component").agg(F.first("sink").alias("node"))).withColumn("sink_side", F.lit(True))
    spread = nodes.join(sides, KEY, "left").join(flows, "component")
    return labels.unionByName(spread.select("component", "flow", "node", F.coalesce("sink_side", F.lit(False)).alias("sink_side")))


def by_edges(edges: DataFrame, task_edges: int = 200_000, most_edges: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges of components of at most `task_edges` edges, and those of larger ones; None where there are none."""
    edges = saved(edges, "cut-edges")
    counts = saved(edges.groupBy("component").count(), "cut-counts")
    largest = counts.agg(F.max("count")).first()[0] or 0
    if most_edges is not None and largest > most_edges:
        raise ValueError(f"a component has {largest} edges; the bound is {most_edges}")
    if largest <= task_edges:
        return edges, None
    large = counts.where(F.col("count") > task_edges).select("component")
    return edges.join(large, "component", "left_anti"), edges.join(large, "component", "left_semi")


def spread_flow(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(component, flow) of a maximum flow, the edges (component, src, dst, cap) it was sought in, and the flow on those
    that have any.

    All edges of the source are filled at first. A phase lays out the nodes by breadth from those with excess until the
    sink is met, keeps the edges that lead to it, each with no more room than there is behind it, and moves the excess
    down layer by layer. What is stuck then is farther from the sink than before, so phases end. Excess that cannot
    reach the sink stays where it is, which leaves the cut the same."""
    ends = F.broadcast(edges.groupBy("component").agg(F.first("source").alias("source"), F.first("sink").alias("sink")))
    sinks = saved(ends.select("component", F.col("sink").alias("node")), "cut-sinks")
    whole = edges.drop("source", "sink").join(ends, "component").where("cap > 0 and src != dst and dst != source and src != sink")
    first = whole.where("src = source").groupBy("component", F.col("dst").alias("node")).agg(F.sum("cap").alias("excess"))
    first = saved(first, "cut-first")
    net = saved(whole.where("src != source").groupBy("component", "src", "dst").agg(F.sum("cap").alias("cap")), "cut-net")
    flowing = saved(net.select("component", "src", "dst", F.col("cap").alias("flow")).where("false"), "cut-flow")
    reached = [first.join(sinks, KEY).select("component", "excess")]
    excess = saved(first.join(sinks, KEY, "left_anti"), "cut-excess")
    while True:
        steps, seen, met = [], [excess.select(*KEY)], []
        front = seen[0]
        while True:
            step = saved(residual(net, flowing, front), "cut-step")
            steps.append(step)
            found = step.select("component", F.col("dst").alias("node")).distinct()
            known = reduce(DataFrame.unionByName, seen)
            found = saved(found.join(known, KEY, "left_anti"), "cut-layer")
            now = saved(found.join(F.broadcast(sinks), KEY, "left_semi"), "cut-met")
            met.append(now)
            seen.append(found)
            front = found.join(F.broadcast(now.select("component")), "component", "left_anti")
            if front.isEmpty():
                break
        # from the sinks back: room behind every node
        ahead, paths = None, []
        for k in range(len(steps) - 1, -1, -1):
            there = met[k].withColumn("behind", F.lit(LARGE))
            there = there if ahead is None else there.unionByName(ahead.where("behind > 0"))
            path = steps[k].join(there.withColumnRenamed("node", "dst"), ["component", "dst"])
            path = saved(path.select("component", "src", "dst", F.least("room", "behind").alias("room")), "cut-path")
            paths.insert(0, path)
            ahead = path.groupBy("component", F.col("src").alias("node")).agg(F.least(F.sum(F.col("room").cast("decimal(38,0)")), F.lit(LARGE)).cast("long").alias("behind"))
        moves, here = [], excess
        for path in paths:
            moved = saved(pushed(path, here), "cut-move")
            moves.append(moved)
            here = moved.groupBy("component", F.col("dst").alias("node")).agg(F.sum("push").alias("excess"))
        moved = reduce(DataFrame.unionByName, moves)
        arrived = moved.join(F.broadcast(sinks.withColumnRenamed("node", "dst")), ["component", "dst"])
        total = saved(arrived.groupBy("component").agg(F.sum("push").alias("excess")), "cut-arrived")
        if total.isEmpty():
            for done in (*steps, *met, *seen[1:], *paths, *moves, excess):
                discard(done)
            break
        reached.append(total)
        turned = F.col("src") > F.col("dst")
        signed = flowing.unionByName(moved.withColumnRenamed("push", "flow")).select(
            "component", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), F.when(turned, -F.col("flow")).otherwise(F.col("flow")).alias("flow")
        )
        signed = signed.groupBy("component", "low", "high").agg(F.sum("flow").alias("flow")).where("flow != 0")
        back = F.col("flow") < 0
        after = saved(signed.select("component", F.when(back, F.col("high")).otherwise(F.col("low")).alias("src"), F.when(back, F.col("low")).otherwise(F.col("high")).alias("dst"), F.abs("flow").alias("flow")), "cut-flow")
        # a component whose sink was not met has its flow; its excess is dropped
        alive = excess.join(F.broadcast(total.select("component")), "component", "left_semi")
        gone = moved.select("component", F.col("src").alias("node"), (-F.col("push")).alias("excess"))
        come = moved.select("component", F.col("dst").alias("node"), F.col("push").alias("excess"))
        left = alive.unionByName(gone).unionByName(come).join(F.broadcast(sinks), KEY, "left_anti")
        left = saved(left.groupBy(*KEY).agg(F.sum("excess").alias("excess")).where("excess > 0"), "cut-excess")
        for done in (*steps, *met, *seen[1:], *paths, *moves, flowing, excess):
            discard(done)
        flowing, excess = after, left
    flows = sinks.select("component", F.lit(0).cast("long").alias("excess"))
    flows = reduce(DataFrame.unionByName, [flows, *reached]).groupBy("component").agg(F.sum("excess").cast("long").alias("flow"))
    return saved(flows, "cut-flows"), net, flowing


def residual(net: DataFrame, flowing: DataFrame, front: DataFrame) -> DataFrame:
    """(component, src, dst, room): residual edges out of the nodes of front."""
    front = front.select("component", F.col("node").alias("src"))
    out = net.join(front, ["component", "src"]).join(flowing, ["component", "src", "dst"], "left")
    out = out.select("component", "src", "dst", (F.col("cap") - F.coalesce("flow", F.lit(0))).alias("room"))
    back = flowing.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("room"))
    return out.where("room > 0").unionByName(back.join(front, ["component", "src"]))


def pushed(path: DataFrame, here: DataFrame) -> DataFrame:
    """(component, src, dst, push): the excess of every node dealt to its edges, one filled after the other."""
    behind = Window.partitionBy("component", "src").orderBy(F.xxhash64("src", "dst"), "dst", "room")
    before = F.coalesce(F.sum(F.col("room").cast("decimal(38,0)")).over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = path.join(here.withColumnRenamed("node", "src"), ["component", "src"]).withColumn("before", before)
    return dealt.where("before < excess").select("component", "src", "dst", F.least(F.col("room"), (F.col("excess") - F.col("before")).cast("long")).alias("push"))


def sink_sides(net: DataFrame, flowing: DataFrame, sinks: DataFrame) -> DataFrame:
    """(component, node) of all nodes from which the sink can be reached in the residual graph."""
    open_ = net.join(flowing, ["component", "src", "dst"], "left").where("cap > coalesce(flow, 0)").select("component", "src", "dst")
    open_ = saved(open_.unionByName(flowing.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"))), "cut-open")
    front = saved(sinks, "cut-side")
    parts = [front]
    while not front.isEmpty():
        step = open_.join(front.withColumnRenamed("node", "dst"), ["component", "dst"]).select("component", F.col("src").alias("node")).distinct()
        front = saved(step.join(reduce(DataFrame.unionByName, parts), KEY, "left_anti"), "cut-side")
        parts.append(front)
        if len(parts) > 8:
            parts = [saved(reduce(DataFrame.unionByName, parts), "cut-side")]
    discard(open_)
    return reduce(DataFrame.unionByName, parts)


def solved(edges: DataFrame) -> DataFrame:
    """min_cut_labels, a component a task: phases of blocking flows on level graphs (Dinic)."""
    from collections import deque

    import numpy as np
    import pandas as pd

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        s, t = frame["source"].iloc[0], frame["sink"].iloc[0]
        names, at = np.unique(np.concatenate([frame["src"], frame["dst"], [s, t]]), return_inverse=True)
        m, n = len(frame), len(names)
        a, b, s, t = at[:m], at[m : 2 * m], int(at[-2]), int(at[-1])
        tail = np.concatenate([a, b])
        order = np.argsort(tail, kind="stable")
        place = np.empty(2 * m, np.int64)
        place[order] = np.arange(2 * m)
        head = np.concatenate([b, a])[order].tolist()
        room = np.concatenate([frame["cap"].to_numpy(np.int64), np.zeros(m, np.int64)])[order].tolist()
        back = place[(order + m) % (2 * m)].tolist()
        first = np.searchsorted(tail[order], np.arange(n + 1)).tolist()
        flow = 0
        while True:
            level = [-1] * n
            level[s] = 0
            todo = deque([s])
            while todo:
                x = todo.popleft()
                for e in range(first[x], first[x + 1]):
                    if room[e] > 0 and level[head[e]] < 0:
                        level[head[e]] = level[x] + 1
                        todo.append(head[e])
            if level[t] < 0:
                break
            turn, path, x = first[:-1].copy(), [], s
            while True:
                if x == t:
                    push = min(room[e] for e in path)
                    flow += push
                    for e in path:
                        room[e] -= push
                        room[back[e]] += push
                    k = next(i for i, e in enumerate(path) if room[e] == 0)
                    x = head[back[path[k]]]
                    del path[k:]
                    continue
                while turn[x] < first[x + 1] and not (room[turn[x]] > 0 and level[head[turn[x]]] == level[x] + 1):
                    turn[x] += 1
                if turn[x] < first[x + 1]:
                    path.append(turn[x])
                    x = head[turn[x]]
                elif path:
                    x = head[back[path.pop()]]
                    turn[x] += 1
                else:
                    break
        side = [False] * n
        side[t] = True
        todo = deque([t])
        while todo:
            x = todo.popleft()
            for e in range(first[x], first[x + 1]):
                if room[back[e]] > 0 and not side[head[e]]:
                    side[head[e]] = True
                    todo.append(head[e])
        return pd.DataFrame({"component": frame["component"].iloc[0], "flow": flow, "node": names, "sink_side": side})

    return edges.groupBy("component").applyInPandas(solve, "component long, flow long, node long, sink_side boolean")
