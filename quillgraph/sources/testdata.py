"""The driver's star schema read as a scholarly corpus.

Customers are citing papers (C...), parts are cited ones (P...); a part of size above 45 is a
stub, of which only title, year and citations are known. Suppliers are authors (A...), brands are
topics (T...), part types are venues (V...), nations are institutions (I...).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import corpus as derive
from quillgraph.plans.lineage import cut


@dataclass
class Corpus:
    """Frames of a corpus; derived ones are planned when first asked for."""

    spark: SparkSession
    works_base: DataFrame  # id, title, year, is_stub, venue_id, cited_by_count
    citations: DataFrame  # src_id, dst_id
    work_authors: DataFrame  # work_id, author_id, position
    work_topics: DataFrame  # work_id, topic_id, score
    work_institutions: DataFrame  # work_id, institution_id
    names: DataFrame  # id, display_name of all entities

    def stored(self) -> Corpus:
        """The same corpus with each frame written once, for plans that read them many times."""
        names = ("works_base", "citations", "work_authors", "work_topics", "work_institutions")
        return replace(self, **{name: cut(getattr(self, name), name) for name in names})

    @cached_property
    def works(self) -> DataFrame:
        return derive.with_citation_counts(self.works_base, self.citations)

    @cached_property
    def work_venues(self) -> DataFrame:
        return self.works_base.where("venue_id is not null").select(F.col("id").alias("work_id"), "venue_id")

    @cached_property
    def authors(self) -> DataFrame:
        return derive.corpus_degree(self.work_authors, self.works_base, "author_id")

    @cached_property
    def institutions(self) -> DataFrame:
        return derive.corpus_degree(self.work_institutions, self.works_base, "institution_id")

    @cached_property
    def venues(self) -> DataFrame:
        return derive.corpus_degree(self.work_venues, self.works_base, "venue_id")

    @cached_property
    def topics(self) -> DataFrame:
        return derive.topic_idf(derive.corpus_degree(self.work_topics, self.works_base, "topic_id"), self.works_base)


def read(spark: SparkSession, sf_dir: str) -> Corpus:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    part = table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    paper, cited = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("P"), "l_partkey")
    citations = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct().select(paper.alias("src_id"), cited.alias("dst_id"))
    first = orders.groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("year"))
    quantity = lines.groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("cited_by_count"))
    stub = F.col("p_size") > 45
    parts = part.join(quantity, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        (F.lit(1970) + F.col("p_size")).cast("int").alias("year"),
        stub.alias("is_stub"),
        F.when(~stub, F.concat(F.lit("V"), "p_type")).alias("venue_id"),
        F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("cited_by_count"),
    )
    customers = table("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"),
        F.col("c_name").alias("title"),
        F.col("year").cast("int").alias("year"),
        F.lit(False).alias("is_stub"),
        F.lit(None).cast("string").alias("venue_id"),
        F.lit(0).cast("long").alias("cited_by_count"),
    )
    known = part.where(~stub).select("p_partkey", "p_brand")
    most = Window.partitionBy("l_partkey").orderBy(F.desc("n"), "l_suppkey")
    sold = lines.join(known, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    written = sold.withColumn("rank", F.row_number().over(most)).where("rank <= 3")
    supplier = table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    work = F.concat(F.lit("P"), "l_partkey").alias("work_id")
    names = (
        supplier.select(F.concat(F.lit("A"), "s_suppkey").alias("id"), F.col("s_name").alias("display_name"))
        .unionByName(known.select(F.concat(F.lit("T"), "p_brand").alias("id"), F.col("p_brand").alias("display_name")).distinct())
        .unionByName(part.where(~stub).select(F.concat(F.lit("V"), "p_type").alias("id"), F.col("p_type").alias("display_name")).distinct())
        .unionByName(table("nation").select(F.concat(F.lit("I"), "n_nationkey").alias("id"), F.col("n_name").alias("display_name")))
    )
    return Corpus(
        spark=spark,
        works_base=parts.unionByName(customers),
        citations=citations,
        work_authors=written.select(work, F.concat(F.lit("A"), "l_suppkey").alias("author_id"), (F.col("rank") - 1).alias("position")),
        work_topics=known.select(F.concat(F.lit("P"), "p_partkey").alias("work_id"), F.concat(F.lit("T"), "p_brand").alias("topic_id"), F.lit(1.0).alias("score")),
        work_institutions=written.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(work, F.concat(F.lit("I"), "s_nationkey").alias("institution_id")).distinct(),
        names=names,
    )


def trust_set(works: DataFrame, n: int = 6) -> DataFrame:
    """(work_id, strength, is_distrust, pos): the n most cited non-stub works, strength going 1..5 and round."""
    top = works.where(~F.col("is_stub")).orderBy(F.desc("in_corpus_cited_by"), "id").limit(n)
    ranked = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("in_corpus_cited_by"), "id")))
    return ranked.select(F.col("id").alias("work_id"), ((F.col("pos") - 1) % 5 + 1).cast("int").alias("strength"), F.lit(False).alias("is_distrust"), "pos")
