"""Nearest point by grids that coarsen until every query is settled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselace.operators.radius import cells
from tesselace.storage import saved


def nearest(queries: DataFrame, points: DataFrame, coordinates: list[str], cell: int, most: int = 40) -> DataFrame:
    """(id, nearest, d2) for each query (id and integer coordinates); ties go to the lower point id. Without points, and
    for a query with a null coordinate, the result is null.

    A round probes the cells around a query; what it finds within one cell width is nearest for certain. Queries that
    are not settled go on with cells twice as wide. Each query is sent to its neighbouring cells, points stay in one.
    Places that several points or queries share are searched once. Cells begin at `cell`, or at less where that holds
    many places, so that a query meets few."""
    places = saved(points.where("id is not null").dropna(subset=coordinates).groupBy(*coordinates).agg(F.min("id").alias("p")), "places")
    if places.isEmpty():
        return queries.select("id", F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("long").alias("d2"))
    n = F.count(F.lit(1))
    crowd = places.groupBy(*cells(coordinates, cell)).agg(n.cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    while crowd > 2 and cell > 1:
        cell, crowd = max(1, cell // 2), crowd / 2 ** len(coordinates)
    keys = [f"cell_{c}" for c in coordinates]
    left, done = queries.select(*coordinates).dropna().distinct(), []
    for _ in range(most):
        probe = left.select(*(F.col(c).alias(f"q_{c}") for c in coordinates), *cells(coordinates, cell))
        for k in keys:
            probe = probe.withColumn(k, F.explode(F.array(*(F.col(k) + i for i in (-1, 0, 1)))))
        there = places.select("p", *(F.col(c).alias(f"p_{c}") for c in coordinates), *cells(coordinates, cell))
        d2 = reduce(lambda a, b: a + b, [(F.col(f"q_{c}") - F.col(f"p_{c}")) * (F.col(f"q_{c}") - F.col(f"p_{c}")) for c in coordinates])
        best = probe.join(there, keys).groupBy(*(f"q_{c}" for c in coordinates)).agg(F.min(F.struct(d2.cast("long").alias("d2"), F.col("p"))).alias("b"))
        found = saved(best.select(*(F.col(f"q_{c}").alias(c) for c in coordinates), F.col("b.p").alias("nearest"), F.col("b.d2").alias("d2")).where(F.col("d2") <= cell * cell))
        done.append(found)
        left = saved(left.join(found.select(*coordinates), coordinates, "left_anti"))
        if left.isEmpty():
            return queries.join(reduce(DataFrame.unionByName, done), coordinates, "left").select("id", "nearest", "d2")
        cell *= 2
    raise RuntimeError("points are too far apart for the cell width")
