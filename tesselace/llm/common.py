"""What the operators of this folder share: reading, shared storage, batches, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselace.storage import discard, release, saved  # noqa: F401  discard and release are for the modules beside this one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and any executor may be lost."""
    return saved(df, tag)


def small_batches(spark: SparkSession, rows: int = 2000, bytes_: str = "16m") -> None:
    """Arrow batches of few rows and bytes: with texts of many kilobytes the default of 10,000 rows is too much for a worker.

    The settings are read when the result is computed, after the operator has returned; they stay with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def batches(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: how rows are dealt to folds."""
    return F.crc32(doc_id.cast("string")) % modulus


def ranked(df: DataFrame, key: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Add a gapless rank from 0 within key, ordered by (bucket of the order columns, order columns).

    A key may hold any share of the rows: the rank within one of `buckets` hash buckets is a window over that
    bucket alone, and what precedes a bucket comes from counts.
    """
    b = f"{name}_bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*key, b).agg(F.count(F.lit(1)).alias("n_here"))
    starts = counts.select(*key, b, F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("start_here"))
    within = Window.partitionBy(*key, b).orderBy(*order)
    return (
        dealt.join(starts, [*key, b])
        .withColumn(name, F.row_number().over(within) - 1 + F.col("start_here"))
        .drop(b, "start_here")
    )


def summed_blobs(df: DataFrame, dtype: str, parts: int, fan_in: int = 64) -> dict[int, bytes]:
    """Element-wise sums of equally long arrays: df has (part, chunk, blob) rows, part below `parts`; one blob a chunk.

    No task adds more than `fan_in` arrays of a chunk for each row that a part has of it. Arrays are added in the
    order of their parts, so that sums of floats come out the same each time."""
    import numpy as np
    import pandas as pd

    def add(key, frame):
        frame = frame.sort_values("part", kind="stable")
        total = sum((np.frombuffer(b, dtype) for b in frame["blob"].iloc[1:]), np.frombuffer(frame["blob"].iloc[0], dtype).copy())
        return pd.DataFrame({"part": [int(key[0])], "chunk": [int(key[1])], "blob": [total.tobytes()]})

    while True:
        parts = -(-parts // fan_in)
        df = df.withColumn("slot", F.floor(F.col("part") / fan_in)).groupBy("slot", "chunk").applyInPandas(add, "part long, chunk int, blob binary")
        if parts <= 1:
            return {r.chunk: bytes(r.blob) for r in df.collect()}


def cutoff_of(counts: DataFrame, count: str, limit: int) -> int | None:
    """The least cutoff that at most `limit` rows have counts above; None where all rows fit.

    Only the histogram of counts reaches the driver: distinct counts are at most sqrt(2 * their sum)."""
    left = limit
    for c, n in sorted(((r[0], r[1]) for r in counts.groupBy(count).agg(F.count(F.lit(1))).collect()), reverse=True):
        if n > left:
            return c
        left -= n
    return None


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows whose count is above cutoff_of."""
    cutoff = cutoff_of(counts, count, limit)
    return counts if cutoff is None else counts.where(F.col(count) > cutoff)


def by_size(it: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many characters of text, or of one row."""
    import pyarrow.compute as pc

    for batch in it:
        size = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if i > start and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(size):
            yield batch.slice(start)
