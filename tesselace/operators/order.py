"""Ranks and prefix sums over any number of rows, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselace.storage import discard, saved


#: Rows of a range that one task sorts.
RANGE_ROWS = 2_000_000


def numbered(df: DataFrame, order: list[str], name: str = "number", amount: Column | None = None) -> DataFrame:
    """Add the number of each row from 0 in the order of the columns, which must tell all rows apart; with `amount` the
    sum of that (integer) over all earlier rows instead.

    Rows are dealt by ranges of the order, of about RANGE_ROWS rows whatever the size of the table; a window runs inside
    each range, and what precedes a range comes from the ranges' totals. Nulls come first. An empty table stays empty."""
    one = F.lit(1) if amount is None else amount
    df = saved(df, "unordered")  # counted, sampled for ranges and dealt: made once
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(ranges, *order).withColumns({"__part": F.spark_partition_id(), "__one": one.cast("long")})
    unordered, dealt = df, saved(dealt, "numbered")
    discard(unordered)
    totals = dealt.groupBy("__part").agg(F.sum("__one").alias("n")).collect()
    starts, so_far = [], 0
    for r in sorted(totals, key=lambda r: r["__part"]):
        starts.append((r["__part"], so_far))
        so_far += r["n"] or 0
    before = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = F.col("__start") + F.coalesce(F.sum("__one").over(within), F.lit(0))
    return dealt.join(before, "__part").withColumn(name, made.cast("long")).drop("__part", "__one", "__start")


def ranked(df: DataFrame, key: list[str], order: list[str], name: str = "rank", size: str | None = None) -> DataFrame:
    """Add the gapless rank from 0 within a key, in order, and (if named) the key's number of rows. Keys are not null."""
    rows = numbered(df, [*key, *order], "__number")
    first = rows.groupBy(*key).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias(size or "__size"))
    out = rows.join(first, key).withColumn(name, F.col("__number") - F.col("__first")).drop("__number", "__first")
    return out if size else out.drop("__size")


def running_sums(df: DataFrame, key: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Add the sum of a whole amount over the rows of a key up to each row, in order. Keys are not null."""
    rows = numbered(df, [*key, *order], "__before", F.col(amount))
    first = rows.groupBy(*key).agg(F.min_by("__before", F.struct(*order)).alias("__first"))
    return rows.join(first, key).withColumn(name, F.col("__before") + F.col(amount) - F.col("__first")).drop("__before", "__first")
