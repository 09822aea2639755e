"""The driver's queries over the star schema read as a scholarly corpus (see sources.testdata)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import biblio, corpus, evaluate, graph, rank, resample, score, search, traverse, views, walks
from quillgraph.plans import layouts
from quillgraph.plans.lineage import cut
from quillgraph.schema import BASELINE, DISTRUST
from quillgraph.sources import testdata

WALKS = 10_000
RING = 20
PAGERANK_ROUNDS = 40


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    # 0.0 in place of the -0.0 that rounding may leave
    return df.withColumns({c: F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits)) for c in columns})


class _Setting:
    """A corpus with its whole graph, written once, and the trust list of the examples."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._made: dict[str, DataFrame] = {}
        self.c = testdata.read(spark, sf_dir).stored()
        self.works = cut(self.c.works, "works")
        self.parts = graph.parts_of(self.c)
        self.edges = graph.stored(self.c, self.parts)
        self.trust = cut(testdata.trust_set(self.works), "trust")

    def positive(self) -> DataFrame:
        return rank.seed_weights(self.trust)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, made once for a query however many lists read it."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def transition(self) -> DataFrame:
        return self._once("transition", lambda: score.stored_transition(self.edges, self.parts))

    def back(self) -> DataFrame:
        return self._once("back", lambda: cut(score.return_diagonal(self.transition()), "return"))

    def _signed(self, seeds: DataFrame) -> DataFrame:
        return score.signed(self.transition(), seeds, [], back=self.back())

    def ranking(self) -> DataFrame:
        """(node, score, rank): signed scores of the aggregate graph, visible papers only."""
        return self._once("ranking", lambda: cut(resample.ranked(rank.visible(self._signed(self.positive()), self.works, self.trust), "score"), "ranking"))

    def merit(self) -> DataFrame:
        """(node, score): closeness to the 200 most cited papers."""
        papers = self.works.select(F.col("id").alias("node"))
        return self._once("merit", lambda: cut(self._signed(rank.global_seeds(self.works)).join(papers, "node", "left_semi"), "merit"))


# --- corpus and graph ---------------------------------------------------------------------


def degree_stats(spark, sf_dir):
    c = testdata.read(spark, sf_dir)
    families = {"author": (c.authors, "corpus_degree"), "topic": (c.topics, "corpus_degree"), "venue": (c.venues, "corpus_degree"), "institution": (c.institutions, "corpus_degree"), "references": (c.works.where("ref_count > 0"), "ref_count"), "citers": (c.works.where("in_corpus_cited_by > 0"), "in_corpus_cited_by")}
    out = None
    for name, (df, column) in families.items():
        row = corpus.degree_stats(df, column).withColumn("family", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def corpus_gate(spark, sf_dir):
    c = testdata.read(spark, sf_dir)
    return corpus.gate_report(c.works, c.citations)


def topic_idf(spark, sf_dir):
    return _round(testdata.read(spark, sf_dir).topics, "idf")


def snowball(spark, sf_dir):
    c = testdata.read(spark, sf_dir)
    return corpus.snowball(c.citations, c.works_base.where("id like 'C%' or year < 1990")).select("id", "referrers", "decision")


def briefs(spark, sf_dir):
    c = testdata.read(spark, sf_dir)
    return rank.briefs(c.works_base.select(F.col("id").alias("node")), c.works_base, c.work_authors, c.names)


def edges_citation(spark, sf_dir):
    c = testdata.read(spark, sf_dir)
    return _round(graph.citation_edges(c.citations, c.works_base), "weight")


def edges_entity(spark, sf_dir):
    c = testdata.read(spark, sf_dir).stored()
    return _round(graph.dedupe(graph.entity_families(c)), "weight")


def coupling_topk(spark, sf_dir):
    return _round(graph.coupling(cut(testdata.read(spark, sf_dir).citations, "citations")), "weight")


def cocitation_topk(spark, sf_dir):
    return _round(graph.cocitation(cut(testdata.read(spark, sf_dir).citations, "citations")), "weight")


def edges_dedup(spark, sf_dir):
    c = testdata.read(spark, sf_dir).stored()
    families = graph.citation_edges(c.citations, c.works_base).unionByName(graph.coupling(c.citations)).unionByName(graph.cocitation(c.citations))
    kept = graph.dedupe(families)
    return _round(kept.groupBy("context", "relation").agg(F.count("*").alias("n"), F.sum("weight").alias("total")), "total", digits=6)


def node_kinds(spark, sf_dir):
    return traverse.kind_counts(graph.build(testdata.read(spark, sf_dir).stored()))


# --- scores -------------------------------------------------------------------------------


def transition(spark, sf_dir):
    return _round(score.transition(cut(graph.build(testdata.read(spark, sf_dir).stored()), "edges")), "p")


def return_diagonal(spark, sf_dir):
    return _round(_Setting(spark, sf_dir).back(), "back")


def propagate_seeds(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    mass = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return _round(score.diffuse(s.transition(), s.positive().select("node", mass.alias("mass")), [], absorb=True), "score")


def propagate_signed(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    last = s.trust.withColumn("is_distrust", F.col("pos") == 6)
    return _round(score.signed(s.transition(), rank.seed_weights(last), [], back=s.back()), "score").where("score != 0")


def background(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    return _round(score.background(s.transition(), s.works), "score", digits=12)


def _contexts(s: _Setting) -> DataFrame:
    found = views.signed(views.transition(s.edges, s.parts), s.positive())
    return cut(found.withColumnRenamed("view", "context"), "contexts")


def compose_mean(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    found = score.compose(_contexts(s), score.context_weights(spark, {"author": 2.0, "citation": 1.0}))
    return _round(found, "score").where("score != 0")


def context_breakdown(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    papers = _contexts(s).join(s.works.where(~F.col("is_stub")).select(F.col("id").alias("node")), "node", "left_semi")
    return _round(score.context_breakdown(papers), "score", "marginal", "share", digits=7)


def ppr_fixed_iter(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    mass = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return _round(score.pagerank(s.transition(), s.positive().select("node", mass.alias("mass")), rounds=PAGERANK_ROUNDS), "score").where("score > 0")


def _with_ring(s: _Setting) -> DataFrame:
    return score.stored_transition(score.with_ring(s.edges, RING, s.trust.orderBy("pos").first().work_id), s.parts)


def _even(s: _Setting) -> DataFrame:
    return s.trust.select(F.col("work_id").alias("node"), F.lit(1.0 / 6).alias("mass"))


def ring_share(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    return _round(score.ring_share(score.diffuse(_with_ring(s), _even(s), [])), "share")


def ring_comparison(spark, sf_dir):
    """One row: the ring's part under the signed scorer and under PageRank to a tolerance, and their ratio."""
    s = _Setting(spark, sf_dir)
    p = _with_ring(s)
    ours = score.signed(p, _even(s).withColumnRenamed("mass", "weight"), [], back=cut(score.return_diagonal(p), "return"))
    plain = score.pagerank(p, _even(s), tolerance=1e-10)
    both = score.ring_share(ours).select("n_ring", F.col("share").alias("signed_share")).crossJoin(F.broadcast(score.ring_share(plain).select(F.col("share").alias("pagerank_share"))))  # one row each
    return _round(both.withColumn("ratio", F.col("signed_share") / F.col("pagerank_share")), "signed_share", "pagerank_share", "ratio", digits=7)


def walk_scores(spark, sf_dir):
    """Walks of three egos: one that trusts all six papers, and two that trust three of them and distrust one."""
    s = _Setting(spark, sf_dir)
    seeds = s.positive().join(s.trust.select(F.col("work_id").alias("node"), "pos"), "node")
    egos = [seeds.select(F.lit(1).alias("ego"), "node", "weight")]
    for ego, trusted, distrusted in ((2, F.col("pos") <= 3, 6), (3, F.col("pos") >= 4, 1)):
        egos.append(seeds.where(trusted | (F.col("pos") == distrusted)).select(F.lit(ego).alias("ego"), "node", F.when(F.col("pos") == distrusted, DISTRUST).otherwise(F.col("weight")).alias("weight")))
    return _round(walks.trust_walks(s.transition(), graph._union(egos), WALKS), "score")


# --- rankings -----------------------------------------------------------------------------


def rank_percentiles(spark, sf_dir):
    works = testdata.read(spark, sf_dir).works.where(~F.col("is_stub"))
    return _round(resample.percentile(works.select("id", "in_corpus_cited_by"), "in_corpus_cited_by", "pct"), "pct")


def citation_percentile(spark, sf_dir):
    works = testdata.read(spark, sf_dir).works.where(~F.col("is_stub"))
    return _round(resample.value_percentiles(works, "cited_by_count"), "percentile")


def popularity_pctile(spark, sf_dir):
    works = testdata.read(spark, sf_dir).works.where(~F.col("is_stub"))
    return _round(resample.strict_percentile(works.select("id", "in_corpus_cited_by"), "in_corpus_cited_by", "below").select("id", "below"), "below")


def _replicates(s: _Setting) -> DataFrame:
    """(replicate, node, score) of the propagation without each seed; 0 has all."""
    seeds = s.positive().join(s.trust.select(F.col("work_id").alias("node"), "pos"), "node")
    runs = seeds.crossJoin(F.broadcast(s.trust.select(F.col("pos").alias("replicate")).union(s.trust.select(F.lit(0)).limit(1)))).where("pos != replicate")  # seven runs
    return cut(score.signed(s.transition(), runs.select("replicate", "node", "weight"), ["replicate"], back=s.back()), "replicates")


def jackknife(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    found = _replicates(s)
    full = rank.visible(found.where("replicate = 0").select("node", "score"), s.works, s.trust)
    return _round(resample.jackknife(full, found.where("replicate > 0"), 6, 6), "score", "stderr", "ci_low", "ci_high")


def _tied(spark, sf_dir) -> DataFrame:
    """Parts by price with an error of a hundredth: a display order with ties."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") * 0.01).alias("stderr"))
    return resample.tie_groups(resample.ranked(part, "p_retailprice", "p_partkey", name="position"), "p_retailprice", "stderr", "position")


def tie_groups(spark, sf_dir):
    return _tied(spark, sf_dir).select("p_partkey", "position", "tie_group")


def tie_runs(spark, sf_dir):
    return resample.tie_runs(_tied(spark, sf_dir), "tie_group", "position")


def lift_rank(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    back = score.background(s.transition(), s.works)
    found = s.ranking().select("node", F.round("score", 12).alias("score"))
    lifted = rank.lift_rank(found, back.select("node", F.round("score", 12).alias("score")))
    return lifted.select("node", F.round("lift", 6).alias("lift"))


def _units(s: _Setting) -> DataFrame:
    """The first three trusted papers came with two uploads, 2 of them with the first."""
    return s.trust.where("pos <= 3").select("work_id", F.when(F.col("pos") <= 2, 1).otherwise(2).cast("long").alias("upload_id"))


def trust_units(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    return resample.trust_units(s.trust, _units(s))


def rank_profile(spark, sf_dir):
    """Every visible paper with its band, rank, tie group and flag; scores to nine digits, bands to as many places below."""
    s = _Setting(spark, sf_dir)
    found = rank.rank_profile(s.edges, s.works, s.trust, _units(s), score.context_weights(spark))
    digits = F.format_string("%.8e", "score").cast("double")
    told = found.select("node", digits.alias("score"), *((digits * F.round(F.col(c) / F.col("score"), 8)).alias(c) for c in ("stderr", "ci_low", "ci_high")), "reliable")
    # numbers as told decide ranks and ties, so that they are those of any engine
    return resample.tie_groups(resample.ranked(cut(told, "told"), "score"), "score", "stderr", "rank")


def flagship(spark, sf_dir):
    """The first page of a ranking with its bands, ties, titles and authors."""
    s = _Setting(spark, sf_dir)
    found = cut(rank.page(rank.rank_profile(s.edges, s.works, s.trust, _units(s), score.context_weights(spark)), 0, 25), "page")
    return found.join(rank.briefs(found, s.c.works_base, s.c.work_authors, s.c.names), "node").orderBy("rank")


def recommendations(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    # novelty is the same at four hops and beyond, so three levels, each of them whole, tell all of it
    near = traverse.distances(s.edges, s.trust.select(F.col("work_id").alias("node")), depth=3, frontier=None)
    found = _round(s.ranking().select("node", "score"), "score", digits=12)
    out = rank.recommendations(found, _round(s.merit(), "score", digits=12), near, dial=0.4)
    return _round(out, "trust_pct", "global_pct", "novelty")


def blindspots(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    mine = _round(s.ranking().select("node", "score"), "score", digits=12)
    return _round(rank.blindspots(mine, _round(s.merit(), "score", digits=12), s.works, s.trust), "global_pct", "trust_pct")


def simulate_moves(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    p, back = s.transition(), s.back()
    less = s.trust.where("pos <= 5")
    after = resample.ranked(rank.visible(_round(score.signed(p, rank.seed_weights(less), [], back=back), "score", digits=12), s.works, s.trust), "score")
    before = resample.ranked(_round(s.ranking().select("node", "score"), "score", digits=12), "score")
    return rank.moves(before, after, beyond_both=True)


def _observations(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    dims = [("event_type", F.col("event_type")), ("user", F.col("user_id").cast("string")), ("day", F.date_format("ts", "yyyy-MM-dd")), ("k", F.get_json_object("props", "$.k"))]
    return e.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("category")) for n, c in dims])).alias("x")).select("x.*").where("category is not null")


def diversity_entropy(spark, sf_dir):
    return rank.entropy(_observations(spark, sf_dir), "dimension", "category")


def concentration(spark, sf_dir):
    return rank.concentration(_observations(spark, sf_dir), "dimension", "category")


# --- paths --------------------------------------------------------------------------------


def bfs_distance(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    return traverse.distances(_round(s.edges, "weight"), s.trust.select(F.col("work_id").alias("node")))


def explain_paths(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    target = s.works.where("not is_stub and id like 'P%'").orderBy("in_corpus_cited_by", "id").first().id
    return traverse.paths(_round(s.edges, "weight"), s.trust.select(F.col("work_id").alias("node")), target)


def subgraph(spark, sf_dir):
    s = _Setting(spark, sf_dir)
    return traverse.subgraph(_round(s.edges, "weight"), s.trust.select(F.col("work_id").alias("node")), 150, kinds=["paper", "author", "venue"])


# --- search and matching ------------------------------------------------------------------


def _search(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"))
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(search.tokens(F.col("text"))).alias("term"))
    return search.postings(docs, stemmed=True), search.stemmed_queries(queries)


def word_stems(spark, sf_dir):
    """Every word of the documents with its stem."""
    return search.stems(_read(spark, sf_dir, "documents").select(F.explode(search.tokens(F.col("text"))).alias("term")))


def text_rank(spark, sf_dir):
    return _round(search.text_rank(*_search(spark, sf_dir)), "rank")


def rrf_fuse(spark, sf_dir):
    found = _round(search.text_rank(*_search(spark, sf_dir)), "rank").withColumn("cited", F.col("id") % 17)
    merit = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).cast("double").alias("score"))
    return search.rrf(found, merit)


def _titles(spark, sf_dir) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("title"), (F.lit(1970) + F.col("p_size")).cast("int").alias("year"))


def _misspelt(spark, sf_dir) -> DataFrame:
    """Every title with an o for each a, and a year off by up to two."""
    t = _titles(spark, sf_dir)
    return t.select(F.col("id").alias("query"), F.translate("title", "a", "o").alias("text"), (F.col("year") + (F.col("id") % 3).cast("int")).alias("year"))


def trigram_match(spark, sf_dir):
    return search.trigram_matches(_misspelt(spark, sf_dir), _titles(spark, sf_dir), 0.3)


def title_match_year(spark, sf_dir):
    return search.trigram_matches(_misspelt(spark, sf_dir), _titles(spark, sf_dir), 0.55, years=True)


def doi_normalise(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    raw = F.concat(F.lit("See https://dx.doi.org/10.1"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("/AbC."), F.col("p_partkey").cast("string"), F.lit(")., and arXiv:2101."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit(" (19"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit(") 2005"))
    return p.select("p_partkey", tx.normal_doi(raw).alias("doi"), tx.arxiv_id(raw).alias("arxiv"), tx.last_year(raw).alias("year"), tx.decade(tx.last_year(raw)).alias("decade"))


# --- evaluation ---------------------------------------------------------------------------


def eval_recall(spark, sf_dir):
    """Each of 200 sets by propagation over the whole graph without its leaks."""
    s = _Setting(spark, sf_dir)
    folds = cut(evaluate.hold_out(evaluate.sample_sets(evaluate.trust_sets(s.c.citations, s.works))), "folds")
    found = _round(evaluate.propagate_sets(s.edges, s.transition(), folds).where("score > 0"), "score", digits=9)
    return evaluate.recall_at(found, folds, s.works, s.edges.where(F.col("context") == BASELINE))


def eval_report(spark, sf_dir):
    return _round(evaluate.report(cut(eval_recall(spark, sf_dir), "recall")), "recall_far", "recall_mean", "recall_lo", "recall_hi", "popularity_mean", "popularity_lo", "popularity_hi")


def spearman(spark, sf_dir):
    works = testdata.read(spark, sf_dir).works.where("not is_stub")
    return _round(resample.spearman(works, "in_corpus_cited_by", "cited_by_count"), "rho")


def kendall(spark, sf_dir):
    works = testdata.read(spark, sf_dir).works.where("not is_stub")
    return _round(resample.kendall(works, "in_corpus_cited_by", "cited_by_count"), "tau")


# --- bibliographies -----------------------------------------------------------------------


def bib_split(spark, sf_dir):
    found = biblio.entries(biblio.trimmed(biblio.cleaned(biblio.region(layouts.frame(spark)))))
    return found.select("doc", "method", "entry", "key", "raw")


def bib_features(spark, sf_dir):
    found = biblio.features(biblio.entries(biblio.trimmed(biblio.cleaned(biblio.region(layouts.frame(spark))))))
    return biblio.adjudicated(found)


def page_furniture(spark, sf_dir):
    """Short lines that stand on two pages or more, a page being 12 lines of a document of its source."""
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    pages = lines.select(F.col("source").alias("doc"), F.concat_ws(":", "doc_id", F.floor(F.col("i") / 12)).alias("page"), "text")
    return biblio.furniture(pages)


QUERIES = {
    f.__name__: f
    for f in (
        degree_stats, corpus_gate, topic_idf, snowball, briefs, edges_citation, edges_entity, coupling_topk, cocitation_topk, edges_dedup,
        node_kinds, transition, return_diagonal, propagate_seeds, propagate_signed, background, compose_mean, context_breakdown,
        ppr_fixed_iter, ring_share, ring_comparison, walk_scores, rank_percentiles, citation_percentile, popularity_pctile, jackknife, tie_groups, tie_runs,
        lift_rank, trust_units, rank_profile, recommendations, blindspots, simulate_moves, diversity_entropy, concentration, bfs_distance,
        explain_paths, subgraph, word_stems, text_rank, rrf_fuse, trigram_match, title_match_year, doi_normalise, eval_recall, eval_report, spearman, kendall, bib_split,
        bib_features, page_furniture,
    )
}
