"""Writers of reports, records and graphs, and what removes them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselace.operators.graph import csr_edges
from tesselace.operators.order import numbered


def markdown(rows: DataFrame, columns: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """(value): the lines of a table, its head first, rows in order. Floats have so many digits; nulls are empty."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.format_number(F.col(c), digits) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    lines = numbered(rows, order, "__at").select((F.col("__at") + 2).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'-|' * len(columns)}")], "at long, value string")
    return head.unionByName(lines)


def write_report(rows: DataFrame, summary: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report's rows as CSV with a head and as a Markdown table, and its summary as JSON, in folders of `path`."""
    kept = rows.select(*columns)
    kept.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown(kept, columns, order).repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(f"{path}/markdown")
    summary.write.mode("overwrite").json(f"{path}/summary")


def append_records(records: DataFrame, path: str) -> None:
    """Add run records to a folder of JSON lines; what is there stays."""
    records.write.mode("append").json(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """A graph's edges (src, dst, cap) laid out by source, with their places and those of their partners, in order."""
    csr_edges(edges).repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").parquet(path)


def prune(spark: SparkSession, path: str, keep: str) -> list[str]:
    """Delete what lies in a folder and does not match the pattern `keep`, unless the folder holds no finished result
    (a _SUCCESS file, itself or in one of its entries). Returns the names that were deleted."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    entries = [s.getPath() for s in files.listStatus(at)]
    done = lambda p: files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    if not done(at) and not any(done(p) for p in entries):
        return []
    gone = []
    for p in entries:
        name = p.getName()
        if name != "_SUCCESS" and not re.search(keep, name):
            files.delete(p, True)
            gone.append(name)
    return sorted(gone)
