"""A table kept up to date by a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselace.operators.scene import maintained


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest finished version of the table; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(at):
        return None
    done = [int(s.getPath().getName()[1:]) for s in files.listStatus(at) if s.getPath().getName().startswith("v") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{folder}/v{max(done)}") if done else None


def maintain(changes: DataFrame, folder: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes (the table's columns, `op`: add or remove, `at`: their order) to the table in `folder`.

    Each batch makes a version v<batch> from the one before it: of several changes of a key in a batch the last one
    holds. A batch that is run again writes the same version anew, so results do not depend on failures."""
    columns = [c for c in changes.columns if c not in ("op", "at")]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*columns, "op"), F.struct("at", "op")).alias("x")).select("x.*")
        added, removed = last.where("op = 'add'").select(*columns), last.where("op = 'remove'").select(*columns)
        kept = None
        for k in range(number - 1, -1, -1):  # the version before this batch, whatever a run that failed has left
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{k}/_SUCCESS")
            if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
                kept = spark.read.parquet(f"{folder}/v{k}")
                break
        new = added if kept is None else maintained(kept, added, removed, key)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
