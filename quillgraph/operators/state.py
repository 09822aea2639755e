"""Changes of trust, uploads and the corpus, as new frames in place of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import corpus, graph, ordered, search
from quillgraph.plans.lineage import cut

# What an imported bibliography's papers are trusted with, and how near a title must be.
IMPORT_STRENGTH, IMPORT_THRESHOLD = 3, 0.55


def set_trust(trust: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` replaces trust rows by work; strength 0 takes the row away."""
    kept = trust.join(changes.select("work_id"), "work_id", "left_anti")
    return kept.unionByName(changes.where("strength > 0").select(*trust.columns))


def local_ids(last: int, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with an id L<n> from ``last`` + 1 on; numbers are never used again."""
    return ordered.numbered(rows, order, "_n").withColumn("id", F.concat(F.lit("CL"), F.col("_n") + last)).drop("_n")


def new_uploads(uploads: DataFrame, have: DataFrame) -> DataFrame:
    """Uploads whose profile has not sent the same bytes before, one of each."""
    hashed = uploads.withColumn("content_hash", F.sha2("payload", 256))
    fresh = hashed.join(have.select("profile_id", "content_hash"), ["profile_id", "content_hash"], "left_anti")
    return corpus.first_per_key(fresh, ["profile_id", "content_hash"], [F.col("id")])


def counters(refs: DataFrame) -> DataFrame:
    """(upload_id, n_parsed, n_matched, n_unresolved) of upload references."""
    return refs.groupBy("upload_id").agg(F.count("*").alias("n_parsed"), F.count_if(F.col("work_id").isNotNull()).alias("n_matched"), F.count_if(F.col("work_id").isNull()).alias("n_unresolved"))


def patch_references(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Decisions, strengths and matches of ``changes`` (upload_id, idx, ...) where they say something."""
    keys = ["upload_id", "idx"]
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    out = refs.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    return out.drop(*[f"_{c}" for c in fields])


def confirm(trust: DataFrame, sources: DataFrame, citations: DataFrame, refs: DataFrame, upload_id: int, own: str | None) -> dict[str, DataFrame]:
    """The state after an upload's accepted references become trust, sources and citations.

    Each source says whether it made the trust row, each citation whether it is new.
    """
    taken = refs.where((F.col("upload_id") == upload_id) & (F.col("decision") == "accept") & F.col("work_id").isNotNull() & ~F.coalesce("is_self_citation", F.lit(False)))
    taken = taken.groupBy("work_id").agg(F.max("strength").alias("strength"))
    fresh = taken.join(trust.select("work_id"), "work_id", "left_anti").select("work_id", "strength", F.lit(False).alias("is_distrust"))
    made = fresh.select("work_id", F.lit(True).alias("created_trust"))
    linked = taken.select("work_id", F.lit(upload_id).cast("long").alias("upload_id")).join(made, "work_id", "left").withColumn("created_trust", F.coalesce("created_trust", F.lit(False)))
    out = {"trust": trust.unionByName(fresh), "sources": sources.unionByName(linked.join(sources, ["work_id", "upload_id"], "left_anti")), "citations": citations}
    if own is not None:
        out["citations"] = citations.unionByName(taken.select(F.lit(own).alias("src_id"), F.col("work_id").alias("dst_id"))).distinct()
    return out


def undo(trust: DataFrame, sources: DataFrame, citations: DataFrame, upload_id: int, own: str | None) -> dict[str, DataFrame]:
    """The state without an upload: a trust row goes only if the upload made it and no other source has it."""
    rest = sources.where(F.col("upload_id") != upload_id)
    made = sources.where((F.col("upload_id") == upload_id) & F.col("created_trust")).select("work_id")
    gone = made.join(rest.select("work_id"), "work_id", "left_anti")
    kept = citations if own is None else citations.where(F.col("src_id") != own)
    return {"trust": trust.join(gone, "work_id", "left_anti"), "sources": rest, "citations": kept}


def import_bibliography(entries: DataFrame, works: DataFrame, trust: DataFrame, threshold: float = IMPORT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(matches, trust) after a bibliography's entries became trust of strength IMPORT_STRENGTH.

    ``entries`` is (ref, doi, title, url) with distinct refs, ``works`` (id, doi, title). An entry is matched by
    its DOI, that of its url if it has none, else by the title at ``threshold`` or more, ties by id. Trigrams are a
    set, so different titles can have the same ones: of these, a work whose title is the entry's word for word goes first.
    Matches are (ref, label, work_id, method, added); works that are trusted already keep what they have.
    """
    own = entries.select("ref", "title", F.coalesce(tx.normal_doi(F.col("doi")), tx.normal_doi(F.col("url"))).alias("_doi"))
    known = works.where("doi is not null").select(tx.normal_doi(F.col("doi")).alias("_doi"), F.col("id").alias("work_id")).where("_doi is not null")
    by_doi = cut(own.join(known, "_doi").groupBy("ref").agg(F.min("work_id").alias("work_id")), "matches")
    left = own.join(by_doi.select("ref"), "ref", "left_anti").where("title is not null")
    first = works.where(F.size(tx.trigrams(F.col("title"))) > 0).groupBy("title").agg(F.min("id").alias("work_id"))
    equal = cut(left.join(first, "title").select("ref", "work_id"), "matches")
    left = left.join(equal.select("ref"), "ref", "left_anti")
    by_title = search.trigram_matches(left.select(F.col("ref").alias("query"), F.col("title").alias("text")), works.where("title is not null").select("id", "title"), threshold)
    titled = equal.unionByName(by_title.select(F.col("query").alias("ref"), F.col("id").alias("work_id"))).withColumn("method", F.lit("title"))
    found = by_doi.withColumn("method", F.lit("doi")).unionByName(titled)
    labelled = own.select("ref", F.coalesce("title", "ref").alias("label")).join(found, "ref", "left")
    have = trust.select("work_id", F.lit(True).alias("_have"))
    matches = cut(labelled.join(have, "work_id", "left").select("ref", "label", "work_id", "method", (F.col("work_id").isNotNull() & F.col("_have").isNull()).alias("added")), "matches")
    fresh = matches.where("added").select("work_id").distinct().select("work_id", F.lit(IMPORT_STRENGTH).alias("strength"), F.lit(False).alias("is_distrust"))
    return matches, trust.select("work_id", "strength", "is_distrust").unionByName(fresh)


def hidden_uploads(works: DataFrame, uploads: DataFrame, profile: int) -> DataFrame:
    """(work_id) of papers that came with uploads of others and not of this profile."""
    own = uploads.where(F.col("profile_id") == profile).select(F.col("work_id"))
    return works.where(F.col("source") == "user_upload").select(F.col("id").alias("work_id")).join(own, "work_id", "left_anti")


def work_edges(c, ids: DataFrame) -> DataFrame:
    """The entity edges of some works, by the builder of the whole graph."""
    only = ids.select(F.col("id").alias("work_id"))
    out = graph.entity_edges(c.work_authors.join(only, "work_id", "left_semi"), c.authors, "author_id", "author", "authored_by", "wrote")
    return out.unionByName(graph.entity_edges(c.work_venues.join(only, "work_id", "left_semi"), c.venues, "venue_id", "venue", "published_in", "publishes"))


def removed_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a node of ``gone``."""
    ids = gone.select("node")
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
