"""Tables that cut lineage: Parquet under the folder that driver and executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset on a local master
(tests, a single machine) is a folder of our own set; a cluster without it is refused, since each
executor would write to its own disk. A written table survives the loss of any executor. Tables
stay until :func:`clear` or the end of the application, because results are lazy and may still
need them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str, str | None]] = []
_dealt: weakref.WeakKeyDictionary[DataFrame, tuple[tuple[str, ...], int]] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a local master without one, a new temporary folder."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quill-shared-"))
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def remember(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Have :func:`clear` delete a folder, and drop its table from the catalog."""
    _made.append((spark, path, table))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, keys: list[str], parts: int) -> DataFrame:
    """Write ``df``, which stands in ``parts`` partitions by ``keys``, as a table of as many buckets.

    What goes by these keys needs no exchange then, however often the table is read.
    """
    spark = df.sparkSession
    table = f"quill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").bucketBy(parts, *keys).option("path", path).saveAsTable(table)
    remember(spark, path, table)
    out = spark.table(table)
    _dealt[out] = tuple(keys), parts
    return out


def is_dealt(df: DataFrame, keys: list[str]) -> bool:
    """Whether a frame is a table that :func:`dealt` wrote by these keys."""
    return df in _dealt and _dealt[df][0] == tuple(keys)


def buckets(df: DataFrame) -> int:
    """How many buckets a table of :func:`dealt` has."""
    return _dealt[df][1]


def clear(spark: SparkSession) -> None:
    """Delete every table that was written so far; call it once results are stored."""
    while _made:
        session, path, table = _made.pop()
        with contextlib.suppress(Exception):
            if table:
                session.sql(f"DROP TABLE IF EXISTS {table}")
            jvm, conf = session.sparkContext._jvm, session.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


@atexit.register
def _at_end() -> None:
    if _made:
        clear(_made[0][0])
