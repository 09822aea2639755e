"""The corpus pipeline: five stages, each written and read again by whoever runs them.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of ``documents``, others that a table has besides included, whatever their names.

Null and empty texts are texts of no words: the quality network scores them like any other, they are
no near copies, hold no repeated string and no benchmark passage, and the mix takes nothing of them.
Of equal or near copies the smallest doc_id stays, a null one last; rows that repeat a doc_id are rows
of their own. Empty tables go through every stage. Without labels every quality score is 0.5, which is
below the threshold, so nothing stays; without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, mixing, ngram_join, quality, scratch, suffix_dedup

#: Strings of as many bytes that stand twice are cut out: less than 50 words take in any language here.
REPEAT_BYTES = 200


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality network rejects; it learns as op5 does."""
    learned = _read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return quality.keep_good(docs, learned, "quality", threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of the texts and sets n_chars to what is left."""
    out = suffix_dedup.without_repeats(docs, length=REPEAT_BYTES)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark passages contaminate."""
    return decontaminate.clean(docs, _read(spark, sf_dir, "benchmark"), n=13, coverage=0.05)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes words from."""
    return mixing.mix_sources(docs, weights=(1, 2, 3), share=1.0, most=3.0).where("taken > 0")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_filter),
    ("mixing sources", source_mix),
]

#: A trained network and a pseudorandom mix are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read as the next one's docs."""
    docs = _read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{number}")
    return docs
