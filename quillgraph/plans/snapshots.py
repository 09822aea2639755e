"""Versions of a table in a folder, and pushes that can be repeated.

A version is written to a folder of its own, and the pointer CURRENT is swapped last, by a rename. A
write that breaks off leaves the pointer on the version before, which stays readable. Pushes are
named; a version lists the names that it holds, so pushing again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.schema import EDGES

POINTER = "CURRENT"


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, folder: str) -> int | None:
    """The number of the version that readers see; None before the first."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/{POINTER}")):
        return None
    stream = fs.open(path(f"{folder}/{POINTER}"))
    try:
        return int(stream.readLong())
    finally:
        stream.close()


def _next(spark: SparkSession, folder: str) -> int:
    """A number above all that were ever begun, broken writes included."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return 1
    names = [x.getPath().getName() for x in fs.listStatus(path(folder))]
    return 1 + max((int(n[2:]) for n in names if n.startswith("v=")), default=0)


def publish(rows: DataFrame, folder: str, pushes: DataFrame | None = None) -> int:
    """Write ``rows`` as the next version, with the names (push) it holds, and swap the pointer to it."""
    spark = rows.sparkSession
    number = _next(spark, folder)
    rows.write.parquet(f"{folder}/v={number}/rows")
    (pushes if pushes is not None else spark.createDataFrame([], "push string")).select("push").write.parquet(f"{folder}/v={number}/pushes")
    path, fs = _fs(spark, folder)
    new, at = path(f"{folder}/{POINTER}.{number}"), path(f"{folder}/{POINTER}")
    stream = fs.create(new, True)
    stream.writeLong(number)
    stream.close()
    # a rename over the pointer where the file system has one; else the old one goes first
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, at, options)
    return number


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the current one if none is named."""
    number = version(spark, folder) if number is None else number
    if number is None:
        raise FileNotFoundError(f"{folder} has no version")
    return spark.read.parquet(f"{folder}/v={number}/rows")


def pushed(spark: SparkSession, folder: str) -> DataFrame:
    """(push): the names that the current version holds."""
    return spark.read.parquet(f"{folder}/v={version(spark, folder)}/pushes")


def push(edges: DataFrame, folder: str) -> int:
    """Merge edges (push, and the columns of edges) into the graph, the stronger of equal pairs; the version then current.

    Names that the graph holds already are passed over; if that is all of them, there is no new version.
    """
    spark = edges.sparkSession
    have = pushed(spark, folder)
    names = edges.select("push").distinct().join(have, "push", "left_anti")
    if names.isEmpty():
        return version(spark, folder)
    fresh = edges.join(names, "push", "left_semi").select(*EDGES.names)
    return publish(graph.merge(read(spark, folder).select(*EDGES.names), fresh), folder, have.unionByName(names))


def reconcile(uploads: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """``uploads`` (upload_id, status, ...) after the edges (upload_id, ...) of pending ones were pushed; those are confirmed.

    Done again, or broken off between the push and the status, it pushes nothing twice.
    """
    pending = uploads.where("status = 'engine_pending'").select("upload_id")
    waiting = edges.join(pending, "upload_id", "left_semi").withColumn("push", F.concat(F.lit("upload:"), "upload_id"))
    push(waiting.select("push", *EDGES.names), folder)
    return uploads.withColumn("status", F.when(F.col("status") == "engine_pending", "confirmed").otherwise(F.col("status")))
