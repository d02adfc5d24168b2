"""Radius joins by grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(coordinates: list[str], radius: int) -> list[Column]:
    return [F.floor(F.col(c) / radius).cast("long").alias(f"cell_{c}") for c in coordinates]


def radius_pairs(points: DataFrame, coordinates: list[str], radius: int, same: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d2) with a < b and squared distance at most radius^2. points: id and integer coordinates.

    Cells are as wide as the radius; one side goes to all neighbouring cells, so each pair meets in exactly one. Ends of
    a pair have the same values, not null, in the columns `same`; those of `carry` are added as a_.. and b_..."""
    keys = [*same, *(f"cell_{c}" for c in coordinates)]
    of = lambda s: points.select(F.col("id").alias(s), *same, *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys([*coordinates, *carry])), *cells(coordinates, radius))
    left, right = of("a"), of("b")
    for k in keys[len(same) :]:
        left = left.withColumn(k, F.explode(F.array(*(F.col(k) + i for i in (-1, 0, 1)))))
    d2 = reduce(lambda x, y: x + y, [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in coordinates])
    return left.join(right, keys).where(F.col("a") < F.col("b")).select("a", "b", d2.cast("long").alias("d2"), *(f"{s}_{c}" for c in carry for s in "ab")).where(F.col("d2") <= radius * radius)


def spread_join(a: DataFrame, b: DataFrame, keys: list[str], most: int = 1 << 26) -> DataFrame:
    """a joined to b on keys. Keys that give over `most` pairs are spread: their rows of a are dealt by hash to as many
    parts as needed, and their rows of b go to each of them, so that no task has all pairs of a key."""
    both = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__a")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__b")), keys)
    large = F.broadcast(both.select(*keys, F.ceil(F.col("__a") * F.col("__b") / most).cast("int").alias("__parts")).where("__parts > 1"))
    parts = F.coalesce("__parts", F.lit(1))
    left = a.join(large, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*a.columns), parts).cast("int")).drop("__parts")
    right = b.join(large, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    tasks = 8 * a.sparkSession.sparkContext.defaultParallelism  # a number that is asked for is not lowered when rows are few
    dealt = lambda df: df.repartition(tasks, *keys, "__part")
    return dealt(left).hint("merge").join(dealt(right), [*keys, "__part"]).drop("__part")


def pairs_within(points: DataFrame, group: str, marked: Column | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of points (id) of one group; with `marked` those with an end for which it holds. Each pair
    comes once if ids do not repeat."""
    p = points.select("id", group, F.coalesce(F.lit(True) if marked is None else marked, F.lit(False)).alias("__marked"))
    both = spread_join(p.where("__marked").select(F.col("id").alias("x"), group), p.withColumnRenamed("id", "y"), [group])
    once = both.where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("__marked")))
    return once.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def repeats(points: DataFrame) -> bool:
    """Whether an id occurs twice."""
    n, ids = points.where("id is not null").agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    return n != ids


def replace_pairs(method: DataFrame, near: DataFrame, located: DataFrame, keep_all: bool = False) -> DataFrame:
    """Pairs (a, b): those of the radius, and of the method's those with an unlocated end (all of them if keep_all)."""
    order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    kept = order(method)
    if not keep_all:
        both = kept.join(located.select(F.col("id").alias("a")), "a", "left_semi").join(located.select(F.col("id").alias("b")), "b", "left_semi")
        kept = kept.join(both, ["a", "b"], "left_anti")
    return kept.unionByName(order(near)).distinct()
