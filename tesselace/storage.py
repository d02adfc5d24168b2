"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tesselace-"))
    return _own[0]


def saved(df: DataFrame, tag: str = "round") -> DataFrame:
    """df written as Parquet and read again: lineage is cut, and any executor may be lost.

    For each folder or file that the driver's JVM makes in a local file system it starts a process to set permissions,
    which for a moment counts as large as the JVM. So it finds the folders there, and no mark of success is written."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if path.startswith("file:///"):
        os.makedirs(f"{path.removeprefix('file://')}/_temporary/0")
        writer = writer.mode("append")
    writer.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._written = path
    return read


def discard(df: DataFrame) -> None:
    """Delete what saved wrote for df; nothing that is still to be computed may read it."""
    spark, path = df.sparkSession, df._written
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Shuffle files are deleted when the driver's JVM finds that no plan uses them any more; ask it to look now.

    It also gives back what its heap has grown by: planning long expressions leaves much garbage, for which the heap
    grows to its limit rather than being cleared. And it gives back the memory beside the heap that has become free:
    compiling leaves much of it with the C library, which keeps some for each of the many threads."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """The driver's JVM returns to the system what its C library holds free; what it says of that, None from a JVM that can't do it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        made = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            made[k] = x
        return made

    of = jvm.java.lang.Class.forName
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JError:
        return None
