"""Text search, fusion with merit, and matching of titles and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import porter
from quillgraph.functions import text as tx
from quillgraph.operators import nearest
from quillgraph.plans.lineage import cut
from quillgraph.schema import RRF_K, SEARCH_LIMIT

# Words that are not indexed, and the weights of title and body.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4}
#: Titles that share a query's rarest word and are looked at before all others; more of them are left to the blocks.
KNOWN = 100


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, stop words left out."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(id, term, class, tf) of (id, title, body): title words are class A, body words B.

    With ``stemmed``, terms are stems, each distinct word stemmed once.
    """
    both = docs.select("id", F.posexplode(F.array(tokens(F.col("title")), tokens(F.col("body")))).alias("k", "words"))
    flat = both.select("id", F.when(F.col("k") == 0, "A").otherwise("B").alias("class"), F.explode("words").alias("term"))
    found = flat.groupBy("id", "term", "class").agg(F.count("*").alias("tf"))
    if not stemmed:
        return found
    return with_stems(found, stems(flat)).groupBy("id", "term", "class").agg(F.sum("tf").alias("tf"))


def stems(words: DataFrame) -> DataFrame:
    """(word, stem) of the distinct words of a frame with a column term.

    Written once: a join on stems must not be pushed below the distinct, where each occurrence would be stemmed.
    """
    return cut(words.select(F.col("term").alias("word")).distinct().withColumn("stem", porter.stem(F.col("word"))), "stems")


def with_stems(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the stem in place of each term."""
    return rows.join(known.withColumnRenamed("word", "term"), "term").drop("term").withColumnRenamed("stem", "term")


def stemmed_queries(queries: DataFrame) -> DataFrame:
    """(query, term) with stems for terms."""
    return with_stems(queries, stems(queries)).select("query", "term").distinct()


def text_rank(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, rank) of the documents that hold every term of a query (query, term).

    The rank adds, for each term and class, the class's weight times the log of its count. Postings
    of other terms are left out before they are shuffled; documents that hold a query's rarest term
    are its candidates, and its other terms are looked up for these alone.
    """
    asked = cut(queries.select("query", "term").distinct(), "asked")
    found = cut(index.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    common = found.groupBy("term").agg(F.countDistinct("id").alias("docs"))
    sized = asked.join(common, "term", "left").select("query", "term", F.coalesce("docs", F.lit(0)).alias("docs"))
    needed = sized.groupBy("query").agg(F.count("*").alias("needed"), F.min(F.struct("docs", "term")).term.alias("term"))
    candidates = needed.join(found.select("id", "term").distinct(), "term").select("query", "id", "needed")
    weight = F.when(F.col("class") == "A", CLASS_WEIGHTS["A"]).otherwise(CLASS_WEIGHTS["B"])
    hits = candidates.join(asked, "query").join(found, ["id", "term"]).groupBy("query", "id", "needed").agg(F.countDistinct("term").alias("met"), F.sum(weight * F.log1p("tf")).alias("rank"))
    return hits.where("met = needed").select("query", "id", "rank")


def trigram_matches(queries: DataFrame, titles: DataFrame, threshold: float, years: bool = False) -> DataFrame:
    """(query, id, similarity): each query's best title at ``threshold`` or more, ties by id.

    ``queries`` is (query, text[, year]), ``titles`` (id, title[, year]); with ``years`` both
    must be within one year. Queries whose trigrams are exactly those of a
    title need no candidates: nothing is more similar, so the least id of such titles is theirs. The others
    know a title that shares their rarest word, if few titles do, and look for what is as similar at least.
    """
    near = ["year"] if years else []
    a = queries.select("query", "text", *near, tx.trigrams(F.col("text")).alias("grams")).where(F.size("grams") > 0)
    b = cut(titles.select("id", "title", *near, tx.trigrams(F.col("title")).alias("grams")).where(F.size("grams") > 0), "titles")
    key = F.array_join(F.array_sort("grams"), "|").alias("_key")
    asked = a.select("query", key, *([F.explode(F.array(*[F.col("year") + i for i in (-1, 0, 1)])).alias("year")] if years else []))
    first = b.select("id", key, *near).groupBy("_key", *near).agg(F.min("id").alias("id"))
    same = cut(asked.join(first, ["_key", *near]).groupBy("query").agg(F.min("id").alias("id")), "same")
    a = cut(a.join(same.select("query"), "query", "left_anti"), "queries")
    words = lambda text: F.explode(F.array_distinct(tx.words(F.col(text)))).alias("word")
    of_titles = b.select("id", words("title"))
    rare = of_titles.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= KNOWN)
    rarest = a.select("query", words("text")).join(rare, "word").groupBy("query").agg(F.min(F.struct("df", "word")).word.alias("word"))
    pairs = rarest.join(of_titles, "word").join(a.select("query", F.col("grams").alias("_grams"), *([F.col("year").alias("_year")] if years else [])), "query").join(b, "id")
    if years:
        pairs = pairs.where(F.abs(F.col("_year") - F.col("year")) <= 1)
    known = pairs.groupBy("query").agg(F.max(tx.similarity(F.col("_grams"), F.col("grams"))).alias("least"))
    a = cut(a.join(known, "query", "left").select("query", "grams", *near, F.coalesce("least", F.lit(0.0)).alias("least")), "queries")
    found = nearest.best(a, b, threshold, years)
    return found.select("query", "id", F.round("similarity", 9).alias("similarity")).unionByName(same.withColumn("similarity", F.lit(1.0)))


def rrf(text: DataFrame, merit: DataFrame, k: int = RRF_K, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(query, position, id, rrf, text_rank, merit_rank): reciprocal ranks of text and merit added.

    ``text`` is (query, id, rank, cited), of which each query's first ``limit`` count; documents
    without merit rank just after those with it.
    """
    w = Window.partitionBy("query")
    top = text.withColumn("text_rank", F.row_number().over(w.orderBy(F.desc("rank"), F.desc("cited"), "id"))).where(F.col("text_rank") <= limit)
    both = top.join(merit.select("id", F.col("score").alias("merit")), "id", "left")
    known = both.where("merit is not null").withColumn("merit_rank", F.row_number().over(w.orderBy(F.desc("merit"), "id"))).select("query", "id", "merit_rank")
    both = both.join(known, ["query", "id"], "left").withColumn("last", F.count("merit_rank").over(w) + 1)
    both = both.withColumn("merit_rank", F.coalesce("merit_rank", "last"))
    fused = both.withColumn("rrf", 1.0 / (k + F.col("text_rank")) + 1.0 / (k + F.col("merit_rank")))
    place = F.row_number().over(w.orderBy(F.desc("rrf"), "merit_rank", "text_rank", "id"))
    return fused.select("query", place.alias("position"), "id", F.round("rrf", 12).alias("rrf"), "text_rank", "merit_rank")


def match_references(refs: DataFrame, works: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(ref, work_id, method, confidence, decision) of references (ref, raw, title, year).

    By DOI first, then arXiv number (as a DOI), then title within a year; the rest goes to
    review. Identifiers are accepted, titles are proposed.
    """
    doi = tx.normal_doi(F.col("raw"))
    arxiv = F.concat(F.lit("10.48550/arxiv."), tx.arxiv_id(F.col("raw")))
    known = works.where("doi is not null and doi != ''").select(F.col("id").alias("work_id"), tx.bare_doi(F.col("doi")).alias("doi"))
    first = known.groupBy("doi").agg(F.min("work_id").alias("work_id"))
    out = refs.withColumns({"doi": doi, "arxiv": arxiv})
    out = out.join(first.withColumnRenamed("work_id", "by_doi"), "doi", "left")
    out = out.join(first.select(F.col("doi").alias("arxiv"), F.col("work_id").alias("by_arxiv")), "arxiv", "left")
    left = out.where("by_doi is null and by_arxiv is null and title is not null and year is not null")
    titled = trigram_matches(left.select(F.col("ref").alias("query"), F.col("title").alias("text"), "year"), works.select("id", "title", "year"), threshold, years=True)
    out = out.join(titled.select(F.col("query").alias("ref"), F.col("id").alias("by_title"), "similarity"), "ref", "left")
    method = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_arxiv").isNotNull(), "arxiv").when(F.col("by_title").isNotNull(), "title").otherwise("none")
    sure = method.isin("doi", "arxiv")
    return out.select("ref", F.coalesce("by_doi", "by_arxiv", "by_title").alias("work_id"), method.alias("method"), F.when(sure, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("confidence"), F.when(sure, "accept").otherwise("pending").alias("decision"))


def self_citations(own: DataFrame, refs: DataFrame) -> DataFrame:
    """(work_id, is_self): whether a referenced work shares an author with the reader's own papers."""
    mine = own.select("author_id").distinct().withColumn("mine", F.lit(True))
    return refs.join(mine, "author_id", "left").groupBy("work_id").agg((F.count("mine") > 0).alias("is_self"))
