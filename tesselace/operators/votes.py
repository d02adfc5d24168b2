"""Votes, ordered folds and weighted accumulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modal_counts(votes: DataFrame, cell: str, order: str, agree: Column) -> DataFrame:
    """Per cell: votes that agree (strict), and votes from the first agreeing one on (cumulative)."""
    so_far = Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = votes.withColumn("agree", agree.cast("int")).withColumn("began", F.max("agree").over(so_far))
    return seen.groupBy(cell).agg(F.sum("agree").cast("long").alias("strict"), F.sum("began").cast("long").alias("cumulative"))


def running_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """x = (x * n + v) / (n + 1), folded in order: the result does not depend on partitions.

    A fold in order is sequential by definition: a key's values are one list in one task (a vertex's observations)."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v"))))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0).alias("n"))
    fold = F.aggregate(listed, zero, lambda s, e: F.struct(((s["x"] * s["n"] + e["v"]) / (s["n"] + 1)).alias("x"), (s["n"] + 1).alias("n")))
    return rows.groupBy(key).agg(fold.alias("s")).select(key, F.col("s.x").alias("mean"), F.col("s.n").cast("long").alias("n"))


def decided(rows: DataFrame, distance: Column, own: Column, other: Column, vote: int, contribute: int) -> DataFrame:
    """Flags: votes where distance < vote * max(own, other), contributes where distance < contribute * other."""
    return rows.withColumn("votes", distance < vote * F.greatest(own, other)).withColumn("contributes", distance < contribute * other)


def weighted_bands(rows: DataFrame, texel: str, band: str, bands: int, weight: str, colour: str) -> DataFrame:
    """sum(w * c) and sum(w) by texel and band; a contribution to a band also feeds all lower frequencies."""
    spread = rows.withColumn("level", F.explode(F.sequence(F.col(band), F.lit(bands - 1))))
    return spread.groupBy(texel, "level").agg(F.sum(F.col(weight) * F.col(colour)).alias("weighted"), F.sum(weight).alias("weight"))


def fused(accumulated: DataFrame, texel: str) -> DataFrame:
    """Mean of each band in whole units, then the sum of the bands."""
    unit = F.expr("case when weight > 0 then weighted div weight end")
    return accumulated.groupBy(texel).agg(F.sum(unit).cast("long").alias("fused"), F.count(unit).alias("bands"))
