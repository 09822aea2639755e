"""Scratch tables of the text operators, and the code that their Python workers need.

Tables are those of :mod:`quillgraph.plans.lineage`, in the folder that driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans.lineage import clear, remember, shared_dir
from quillgraph.plans.lineage import cut as table

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="quill-ship-")) / "quillgraph_llm.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in [root / "__init__.py", root / "plans/__init__.py", root / "plans/lineage.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(f, f"quillgraph/{f.relative_to(root)}")
    sc.addPyFile(str(packed))
    _shipped.add(sc.applicationId)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As :func:`table`, in ``n`` buckets by ``key``: joins and groups by it need no exchange of this side."""
    spark = df.sparkSession
    name = f"quill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    remember(spark, path, name)
    return spark.table(name)


__all__ = ["bucketed", "clear", "shared_dir", "ship", "table"]
