"""Bounded samples of labelled rows, for classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(doc_id, text) of labelled documents, and their labels by doc_id.

    Of each label, up to ``rows`` rows come, the first by a hash of the id, and of these the first
    ones that hold ``most_bytes`` of text together, one at the least; the text that would exceed it ends
    the sample, so that long texts are as likely in it as short ones. Texts are whole. ``labels`` has
    doc_id and the 0/1 column ``label``; rows with a null in either and ids with both labels are
    left out. Of documents that repeat a doc_id the first text in order counts; null is empty.
    Without any such row the frame is None.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    picked: dict[int, int] = {}
    for y in (0, 1):
        picked |= {r.doc_id: y for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    if not picked:
        return None, {}
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in picked], "doc_id long"))  # 2 * rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = scratch.table(texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "learned")
    sizes = found.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    held, kept, full = {0: 0, 1: 0}, {}, set()
    for r in sizes:
        y = picked[r.doc_id]
        if held[y] and held[y] + r["size"] > most_bytes:
            full.add(y)
        if y not in full:
            kept[r.doc_id] = y
            held[y] += max(1, r["size"])
    if len(kept) < len(sizes):
        found = found.join(F.broadcast(spark.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id")
    return found, kept
