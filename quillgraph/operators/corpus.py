"""Normalising, merging and deriving the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in ``order`` (a full record before a stub, say)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``have`` with the same key; repeating it changes nothing.

    Of new rows with one key the least counts, by their other columns in order.
    """
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[c if c in keys else F.col(f"_r.`{c}`").alias(c) for c in new.columns]) if rest else new.distinct()
    return have.join(new.select(*keys), keys, "left_anti").unionByName(one)


def closed_citations(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Distinct citations of which both ends are works, without self-citations."""
    ids = works.select("id")
    kept = citations.where("src_id != dst_id").distinct()
    kept = kept.join(ids, F.col("src_id") == F.col("id"), "left_semi")
    return kept.join(ids, F.col("dst_id") == F.col("id"), "left_semi")


def with_citation_counts(works: DataFrame, citations: DataFrame) -> DataFrame:
    """``works`` with ref_count and in_corpus_cited_by, recomputed from the citations."""
    out = citations.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("ref_count"))
    into = citations.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("in_corpus_cited_by"))
    zero = F.lit(0).cast("long")
    return works.join(out, "id", "left").join(into, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("ref_count", "in_corpus_cited_by")})


def corpus_degree(links: DataFrame, works: DataFrame, entity: str) -> DataFrame:
    """(entity, corpus_degree): distinct non-stub works of each entity."""
    full = works.where(~F.col("is_stub")).select(F.col("id").alias("work_id"))
    return links.join(full, "work_id", "left_semi").groupBy(entity).agg(F.countDistinct("work_id").alias("corpus_degree"))


def topic_idf(topics: DataFrame, works: DataFrame) -> DataFrame:
    """``topics`` (topic_id, corpus_degree) with idf = max(.01, ln(N / (1 + degree)))."""
    n = works.where(~F.col("is_stub")).agg(F.count("*").alias("n_works"))
    idf = F.greatest(F.lit(0.01), F.log(F.col("n_works") / (1 + F.col("corpus_degree"))))
    return topics.crossJoin(F.broadcast(n)).withColumn("idf", idf).drop("n_works")  # one row


def degree_stats(degrees: DataFrame, column: str) -> DataFrame:
    """One row: n, min, median, mean, p90, p99, max of a count column, percentiles exact and continuous."""
    c = F.col(column)
    return degrees.agg(
        F.count("*").alias("n"),
        F.min(c).alias("least"),
        F.percentile(c, 0.5).alias("median"),
        F.round(F.avg(c), 9).alias("mean"),
        F.percentile(c, 0.9).alias("p90"),
        F.percentile(c, 0.99).alias("p99"),
        F.max(c).alias("most"),
    )


def gate_report(works: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: works, stubs, orphans, resolved share and whether the corpus is fit to rank."""
    counted = works.agg(
        F.count("*").alias("n_works"),
        F.count_if("is_stub").alias("n_stubs"),
        F.count_if(~F.col("is_stub")).alias("n_full"),
        F.count_if((F.col("ref_count") == 0) & (F.col("in_corpus_cited_by") == 0)).alias("n_orphans"),
        F.count_if(~F.col("is_stub") & ((F.col("ref_count") > 0) | (F.col("in_corpus_cited_by") > 0))).alias("n_linked"),
    )
    linked = citations.agg(F.count("*").alias("n_citations"))
    out = counted.crossJoin(F.broadcast(linked))  # one row each
    share = F.col("n_linked") / F.greatest(F.col("n_full"), F.lit(1))
    return out.withColumn("linked_share", F.round(share, 9)).withColumn("passes", (F.col("n_full") >= 2500) & (share >= 0.9))


def snowball(citations: DataFrame, full: DataFrame, least: int = 3) -> DataFrame:
    """(id, referrers, decision): cited works that are not full yet; ``least`` referrers promote, fewer make a stub."""
    seen = citations.join(full.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
    n = seen.groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("referrers"))
    return n.withColumn("decision", F.when(F.col("referrers") >= least, "promote").otherwise("stub"))
