"""The weighted graph: edge families, neighbours by shared links, and merging.

Edges are (src, dst, weight, context, relation). Paper-to-paper edges carry the baseline context
and belong to every view; entity edges carry their family's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import shared
from quillgraph.plans.lineage import cut, dealt
from quillgraph.schema import BASELINE, HALF_LIFE, HUB_CAP, LEAST_AGE_FACTOR, LEAST_SHARED, NEIGHBOURS, REFERENCE_YEAR
from quillgraph.schema import RELATION_WEIGHTS as W

#: Edges in a part.
PART = 500_000


def epoch_factor(year, half_life: float = HALF_LIFE):
    """Ageing by the half-life, never below the floor; 1 where the year is unknown."""
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0), F.lit(REFERENCE_YEAR) - year)
    return F.when(year.isNull() | (year == 0), 1.0).otherwise(F.greatest(F.lit(LEAST_AGE_FACTOR), F.pow(F.lit(0.5), age / half_life)))


def damp(degree):
    return 1.0 / F.sqrt(F.greatest(degree, F.lit(1)))


def _edges(rows: DataFrame, src, dst, weight, context: str, relation: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"), F.lit(context).alias("context"), F.lit(relation).alias("relation"))


def citation_edges(citations: DataFrame, works: DataFrame) -> DataFrame:
    """cites, and cited_by with the same factor, which is the cited work's."""
    aged = citations.join(works.select(F.col("id").alias("dst_id"), epoch_factor(F.col("year")).alias("factor")), "dst_id")
    s, d, f = F.col("src_id"), F.col("dst_id"), F.col("factor")
    return _edges(aged, s, d, W["cites"] * f, BASELINE, "cites").unionByName(_edges(aged, d, s, W["cited_by"] * f, BASELINE, "cited_by"))


def entity_edges(links: DataFrame, entities: DataFrame, entity: str, context: str, out: str, back: str, strength=None) -> DataFrame:
    """Both directions between works and entities of degree above 1; the way back is damped by degree."""
    rows = links.join(entities.where("corpus_degree > 1"), entity)
    factor = F.lit(1.0) if strength is None else strength
    forth = _edges(rows, F.col("work_id"), F.col(entity), W[out] * factor, context, out)
    return forth.unionByName(_edges(rows, F.col(entity), F.col("work_id"), W[back] * factor * damp(F.col("corpus_degree")), context, back))


def topic_edges(links: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic edges scaled by idf over the largest idf among the joined rows."""
    used = topics.where("corpus_degree > 1").join(links.select("topic_id").distinct(), "topic_id", "left_semi")
    top = used.agg(F.max("idf").alias("top_idf"))
    scaled = used.crossJoin(F.broadcast(top))  # one row
    return entity_edges(links, scaled, "topic_id", "topic", "tagged", "tags", F.col("idf") / F.col("top_idf"))


def _top_neighbours(pairs: DataFrame, relation: str, k: int, of: DataFrame | None = None) -> DataFrame:
    """Each paper's k strongest of the undirected pairs (a, b, weight), as directed edges; with ``of`` (a), of those papers.

    Weights are rounded to 12 digits first, so that equal fractions tie however they were formed.
    """
    weight = F.round("weight", 12).alias("weight")
    # each pair both ways from one row, so that the pairs are made once
    ways = F.array(F.struct(F.col("a"), F.col("b"), weight), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), weight))
    each = pairs.select(F.explode(ways).alias("way")).select("way.*")
    if of is not None:
        each = each.join(of.distinct(), "a", "left_semi")
    w = Window.partitionBy("a").orderBy(F.desc("weight"), F.desc("b"))
    kept = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _edges(kept, F.col("a"), F.col("b"), F.col("weight"), BASELINE, relation)


def coupling(citations: DataFrame, cap: int = HUB_CAP, least: int = LEAST_SHARED, k: int = NEIGHBOURS, of: DataFrame | None = None) -> DataFrame:
    """Papers with common references, the strongest of :func:`coupled` for each; with ``of`` (src_id), the lists of those papers alone."""
    return _top_neighbours(coupled(citations, cap, least, of), "couples", k, None if of is None else of.select(F.col("src_id").alias("a")))


def coupled(citations: DataFrame, cap: int = HUB_CAP, least: int = LEAST_SHARED, of: DataFrame | None = None) -> DataFrame:
    """(a, b, weight) of papers with common references: .35 n over the size of the union of their full reference lists.

    n counts references with 2 to ``cap`` citers. The union's size needs the intersection with
    all references; hubs are too many to join on, but a pair that shares n kept references
    finds its hub intersection from the hub references of the two papers alone. With ``of`` (src_id),
    the pairs with one of those papers.
    """
    beyond = cut(citations.groupBy("dst_id").agg(F.count("*").alias("citers")).where(F.col("citers") > cap).select("dst_id"), "hubs")
    kept = citations.where("dst_id is not null").join(beyond, "dst_id", "left_anti")
    hubs = citations.join(beyond, "dst_id", "left_semi").groupBy("src_id").agg(F.collect_set("dst_id").alias("hubs"))
    sizes = citations.groupBy("src_id").agg(F.count("*").alias("refs")).join(hubs, "src_id", "left")
    pairs = shared.pairs(kept, "dst_id", "src_id", least, of, citations)
    for x in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("src_id").alias(x), F.col("refs").alias(f"refs_{x}"), F.col("hubs").alias(f"hubs_{x}")), x)
    common = F.col("n") + F.coalesce(F.size(F.array_intersect("hubs_a", "hubs_b")), F.lit(0))
    weight = W["couples"] * F.col("n") / (F.col("refs_a") + F.col("refs_b") - common)
    return pairs.select("a", "b", weight.alias("weight"))


def _cocited_pairs(citations: DataFrame, cap: int, least: int, of: DataFrame | None = None) -> DataFrame:
    """(a, b, n) of papers cited together by at least ``least`` papers of at most ``cap`` references."""
    long = cut(citations.groupBy("src_id").agg(F.count("*").alias("refs")).where(F.col("refs") > cap).select("src_id"), "long")
    kept = citations.where("src_id is not null").join(long, "src_id", "left_anti")
    return shared.pairs(kept, "src_id", "dst_id", least, of, citations)


def cocitation(citations: DataFrame, cap: int = HUB_CAP, least: int = LEAST_SHARED, k: int = NEIGHBOURS) -> DataFrame:
    """Papers cited together by papers of at most ``cap`` references, on a log scale of the largest count."""
    pairs = _cocited_pairs(citations, cap, least)
    # the largest count over all pairs is the largest over those kept, if any is kept
    top = pairs.agg(F.max("n").alias("top"))
    weight = W["co_cited"] * F.log1p("n") / F.log1p("top")
    return _top_neighbours(pairs.crossJoin(F.broadcast(top)).withColumn("weight", weight), "co_cited", k)  # one row


def cocited_lists(citations: DataFrame, cap: int = HUB_CAP, least: int = LEAST_SHARED, k: int = NEIGHBOURS, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, n): the pairs behind :func:`cocitation` with their counts; with ``of`` (dst_id), of those papers alone.

    Weights grow with the counts, so these lists are those by weight.
    """
    found = _top_neighbours(_cocited_pairs(citations, cap, least, of).withColumn("weight", F.col("n").cast("double")), "co_cited", k, None if of is None else of.select(F.col("dst_id").alias("a")))
    return found.select("src", "dst", F.col("weight").cast("long").alias("n"))


def dedupe(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """The strongest edge of each (src, dst, context); of equal ones, the first in RELATION_WEIGHTS.

    Rows are dealt by src, into ``parts`` if said, and sorted once, after that: hardly any are equal, so
    that choosing before the exchange too would sort all of them twice.
    """
    place = F.create_map(*[x for i, r in enumerate(W) for x in (F.lit(r), F.lit(-i))])[F.col("relation")]
    best = Window.partitionBy("src", "dst", "context").orderBy(F.desc("weight"), F.desc(place), F.desc("relation"))
    rows = edges.repartition("src") if parts is None else edges.repartition(parts, "src")
    return rows.withColumn("_i", F.row_number().over(best)).where("_i = 1").select("src", "dst", "weight", "context", "relation")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def entity_families(c) -> DataFrame:
    """Author, topic, venue and institution edges of a corpus, each way."""
    return _union(
        [
            entity_edges(c.work_authors, c.authors, "author_id", "author", "authored_by", "wrote"),
            topic_edges(c.work_topics, c.topics),
            entity_edges(c.work_venues, c.venues, "venue_id", "venue", "published_in", "publishes"),
            entity_edges(c.work_institutions, c.institutions, "institution_id", "institution", "affiliated", "hosts"),
        ]
    )


def families(c) -> DataFrame:
    """All families of a corpus, parallel edges not merged: for what takes the strongest of them itself."""
    return _union([citation_edges(c.citations, c.works_base), entity_families(c), coupling(c.citations), cocitation(c.citations)])


def build(c, parts: int | None = None) -> DataFrame:
    """All families of a corpus, merged."""
    return dedupe(families(c), parts)


def around(c, nodes: DataFrame) -> DataFrame:
    """The edges of :func:`build` out of or into ``nodes`` (node), which are few: others are left out before they are exchanged."""
    ids = nodes.select("node").distinct()
    rows = families(c)
    for end in ("src", "dst"):
        rows = rows.join(F.broadcast(ids.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))), end, "left")
    return dedupe(rows.where("_src or _dst").select("src", "dst", "weight", "context", "relation"))


def parts_of(c) -> int:
    """How many parts the edges of a corpus are dealt into; a citation brings some four edges with it."""
    return max(c.spark.sparkContext.defaultParallelism, 4 * c.citations.count() // PART)


def stored(c, parts: int) -> DataFrame:
    """All families of a corpus, merged and written by src."""
    return dealt(build(c, parts), "edges", ["src"], parts)


def view(edges: DataFrame, context: str) -> DataFrame:
    """The edges of a context: paper edges always, entity edges of the context; "" has all."""
    if context == "":
        return edges
    return edges.where(F.col("context").isin(sorted({BASELINE, context})))


def neighbours(edges: DataFrame, node: str, direction: str = "out", least: float | None = None) -> DataFrame:
    """Edges out of, into, or around a node, strongest first."""
    at = {"out": F.col("src") == node, "in": F.col("dst") == node, "all": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    found = edges.where(at)
    if least is not None:
        found = found.where(F.col("weight") >= least)
    return found.orderBy(F.desc("weight"), "src", "dst", "context")


def merge(have: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both, the stronger of each (src, dst, context) with its relation."""
    return dedupe(have.unionByName(new))


def save(edges: DataFrame, folder: str, version: int) -> str:
    """Write a snapshot of the graph under its version; readers move to it when they choose."""
    path = f"{folder}/v={version}"
    edges.write.mode("overwrite").parquet(path)
    return path
