"""Driver queries of display, list and look-up operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import display
from quillgraph.operators import graph, lookup, resample
from quillgraph.plans.oracles import CORPUS, EDGES
from quillgraph.plans.pages import _profile
from quillgraph.plans.queries import _read, _round
from quillgraph.sources import testdata


def score_texts(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    x, error = F.col("p_size") / 7.0, (F.col("p_partkey") % 400 + 0.5) / 30.0
    share = (F.col("p_partkey") % 1009) / 1008.0
    return p.select("p_partkey", display.score_text(x, error).alias("score"), display.score_text(x / 100, F.lit(0.0)).alias("plain"), display.count_text(F.col("p_partkey") * 7919).alias("n"), display.percentile_text(share).alias("pct"), display.search_title(F.concat_ws(":", "p_name", "p_type")).alias("title"))


def score_bars(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("score"), (F.col("p_size") / 100.0).alias("e"))
    rows = p.select("p_partkey", "score", (F.col("score") - F.col("e")).alias("ci_low"), (F.col("score") + F.col("e")).alias("ci_high"))
    return _round(display.bars(rows), "bar_center", "bar_low", "bar_high", "shade").select("p_partkey", "bar_center", "bar_low", "bar_high", "clipped", "shade")


def match_words(spark, sf_dir):
    k = F.col("p_partkey")
    method = F.element_at(F.array(*[F.lit(m) for m in display.MATCHES]), (k % 6 + 1).cast("int"))
    words = display.match_words(method, (k % 10) / 10.0, k % 4 == 0, k % 3 == 0, k % 5 == 0)
    return _read(spark, sf_dir, "part").select("p_partkey", words.alias("w")).select("p_partkey", "w.*")


def people_texts(spark, sf_dir):
    """Every paper with its first two authors in words."""
    c = testdata.read(spark, sf_dir)
    named = c.work_authors.join(c.names.withColumnRenamed("id", "author_id"), "author_id")
    lists = named.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "display_name"))), lambda x: x["display_name"]).alias("names"))
    return c.works_base.select("id").join(lists.withColumnRenamed("work_id", "id"), "id", "left").select("id", display.people_text(F.col("names"), 2).alias("people"))


def engine_neighbours(spark, sf_dir):
    c, _, trust = _profile(spark, sf_dir)
    nodes = trust.select(F.col("work_id").alias("node"))
    return lookup.neighbours(_round(graph.around(c, nodes), "weight"), nodes, "all", offset=5, count=20, gte=0.01, lt=0.9)


def engine_scores(spark, sf_dir):
    """Trusted papers as egos, their scores by the strongest edge: papers of a range, paged."""
    c, _, trust = _profile(spark, sf_dir)
    found = graph.families(c).join(F.broadcast(trust.select(F.col("work_id").alias("src"))), "src", "left_semi").groupBy(F.col("src").alias("ego"), F.col("dst").alias("node")).agg(F.max("weight").alias("score"))
    return lookup.scores(_round(found, "score"), "author", 0, 50, gt=0.1, lte=0.6)


def engine_mutual(spark, sf_dir):
    c = testdata.read(spark, sf_dir).stored()
    return _round(lookup.mutual_ways(graph.families(c)), "score", "back")


def engine_pruned(spark, sf_dir):
    """Sales as edges from supplier to part, by value: those that count beside the supplier's best."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("weight"))
    return _round(lookup.pruned(lines), "weight", digits=2).groupBy("src").agg(F.count("*").alias("n"), F.min("weight").alias("least"))


def _ranked_works(spark, sf_dir):
    _, works, _ = _profile(spark, sf_dir)
    nodes = works.where("not is_stub").select(F.col("id").alias("node"), "year", F.col("cited_by_count").alias("citations"), "in_corpus_cited_by")
    return resample.ranked(nodes, "in_corpus_cited_by").drop("in_corpus_cited_by")


def sorted_by_year(spark, sf_dir):
    return lookup.arranged(_ranked_works(spark, sf_dir), "year", descending=True)


def sorted_by_citations(spark, sf_dir):
    return lookup.arranged(_ranked_works(spark, sf_dir), "citations", descending=False)


def first_seen(spark, sf_dir):
    """Parts in the order in which orders first name them."""
    return lookup.first_seen(_read(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_partkey"])


def topic_pattern(spark, sf_dir):
    c, works, _ = _profile(spark, sf_dir)
    return lookup.by_topic(works, c.work_topics, c.names, "brand#1%", 25)


def shown_works(spark, sf_dir):
    """Each seventh size counts as an upload, by the profile of the part's key modulo 3."""
    p = _read(spark, sf_dir, "part")
    works = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, "user_upload").otherwise("openalex").alias("source"))
    uploads = p.select(F.col("p_partkey").alias("work_id"), (F.col("p_partkey") % 3).alias("profile_id"))
    return lookup.shown(works, uploads, 1)


def listed_references(spark, sf_dir):
    raw = F.when(F.col("p_size") % 9 != 0, F.to_json(F.struct(F.slice(F.array(*[F.lit(f"W{i}") for i in range(5)]), F.lit(1), (F.col("p_size") % 6).cast("int")).alias("referenced_works"))))
    return _read(spark, sf_dir, "part").select("p_partkey", lookup.n_listed(raw, "referenced_works").alias("n_references"))


QUERIES = {
    f.__name__: f
    for f in (
        score_texts, score_bars, match_words, people_texts, engine_neighbours, engine_scores, engine_mutual, engine_pruned,
        sorted_by_year, sorted_by_citations, first_seen, topic_pattern, shown_works, listed_references,
    )
}


def _fixed(x: str, places: str) -> str:
    cases = " ".join(f"WHEN {i} THEN printf('%.{i}f', {x})" for i in range(9))
    return f"CASE {places} {cases} END"


RANKED = f"""{CORPUS}, r AS (SELECT id AS node, CAST(year AS INTEGER) AS year, cited_by_count AS citations, CAST(row_number() OVER (ORDER BY in_corpus_cited_by DESC, id) AS INTEGER) AS rank FROM works WHERE NOT is_stub)"""

ORACLES = {
    "score_texts": f"""WITH v AS (SELECT *, p_size / 7 AS x, CAST(least(8, greatest(0, -floor(log10((p_partkey % 400 + 0.5) / 30)))) AS INTEGER) AS d, p_size / 700 AS y, p_partkey % 1009 / 1008 * 100 AS pct FROM part),
u AS (SELECT *, CAST(round(pct) AS INTEGER) AS o FROM v)
SELECT p_partkey, CASE WHEN x <> 0 AND abs(x) < pow(10, -d) THEN '<' || {_fixed('pow(10, -d)', 'd')} ELSE {_fixed('x', 'd')} END AS score,
  CASE WHEN y <> 0 AND y < 0.0001 THEN '<0.0001' ELSE printf('%.4f', y) END AS plain, format('{{:,}}', CAST(p_partkey AS BIGINT) * 7919) AS n,
  CASE WHEN pct >= 99.5 AND pct < 100 THEN '99th' ELSE o || CASE WHEN o % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o % 10 = 1 THEN 'st' WHEN o % 10 = 2 THEN 'nd' WHEN o % 10 = 3 THEN 'rd' ELSE 'th' END END AS pct,
  p_name || ' ' || p_type AS title FROM u""",
    "score_bars": """WITH v AS (SELECT p_partkey, p_retailprice / 1000 AS s, p_size / 100 AS e FROM part),
m AS (SELECT min(s - e) AS a, max(s + e) AS b, min(s) AS v, max(s) AS w FROM v), k AS (SELECT a - 0.06 * (b - a) AS lo, b + 0.06 * (b - a) AS hi, v, w FROM m),
g AS (SELECT p_partkey, (s - lo) / (hi - lo) AS c, (s - e - lo) / (hi - lo) AS l, (s + e - lo) / (hi - lo) AS h, (s - v) / (w - v) AS shade FROM v, k)
SELECT p_partkey, round(c, 9) AS bar_center, round(l, 9) AS bar_low, round(CASE WHEN h - l < 0.01 THEN least(1, l + 0.01) ELSE h END, 9) AS bar_high, l < 0 OR h > 1 AS clipped, round(shade, 9) AS shade FROM g""",
    "match_words": """WITH v AS (SELECT p_partkey, p_partkey % 6 AS m, p_partkey % 4 = 0 AS w, p_partkey % 3 = 0 AS r, p_partkey % 5 = 0 AS u FROM part)
SELECT p_partkey, CASE WHEN u THEN 'couldn''t check OpenAlex' ELSE ['matched by DOI', 'matched by arXiv id', 'matched by you', 'candidate (title match)', 'candidate (OpenAlex search)', 'unmatched'][m + 1] END AS label,
  CASE WHEN u THEN 'caution' ELSE ['positive', 'positive', 'positive', 'accent', 'accent', 'neutral'][m + 1] END AS tone,
  CASE WHEN NOT u AND m IN (3, 4) THEN p_partkey % 10 / 10 END AS confidence, NOT w AND r AS will_be_added, CASE WHEN u THEN NOT w AND NOT r ELSE m = 5 AND (w OR NOT r) END AS unmatched FROM v""",
    "people_texts": f"""WITH {CORPUS}, l AS (SELECT work_id, list(s_name ORDER BY position) AS names FROM wa JOIN supplier ON 'A' || s_suppkey = e GROUP BY 1)
SELECT id, CASE WHEN names IS NULL THEN 'Unattributed' ELSE array_to_string(names[1:2], ', ') || CASE WHEN len(names) > 2 THEN ' and ' || (len(names) - 2) || ' more' ELSE '' END END AS people FROM base LEFT JOIN l ON work_id = id""",
    "engine_neighbours": f"""WITH {EDGES}, a AS (SELECT src AS node, dst AS other, round(weight, 9) AS weight, context FROM edges UNION ALL SELECT dst, src, round(weight, 9), context FROM edges WHERE src <> dst)
SELECT * FROM (SELECT CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, context) AS INTEGER) AS place, node, other, weight, context FROM a WHERE weight >= 0.01 AND weight < 0.9 AND node IN (SELECT work_id FROM trust)) WHERE place BETWEEN 6 AND 25""",
    "engine_scores": f"""WITH {EDGES}, s AS (SELECT src AS ego, dst AS node, round(max(weight), 9) AS score FROM edges WHERE src IN (SELECT work_id FROM trust) GROUP BY ALL)
SELECT * FROM (SELECT CAST(row_number() OVER (PARTITION BY ego ORDER BY score DESC, node) AS INTEGER) AS place, ego, node, score FROM s WHERE node LIKE 'A%' AND score > 0.1 AND score <= 0.6) WHERE place <= 50""",
    "engine_mutual": f"""WITH {EDGES}, s AS MATERIALIZED (SELECT src AS ego, dst AS node, max(weight) AS score FROM edges GROUP BY ALL)
SELECT a.ego, a.node, round(a.score, 9) AS score, round(b.score, 9) AS back FROM s a JOIN s b ON a.ego = b.node AND a.node = b.ego""",
    "engine_pruned": """WITH e AS (SELECT l_suppkey AS src, l_extendedprice * l_extendedprice AS w FROM lineitem), m AS (SELECT src, max(w) AS top FROM e GROUP BY 1)
SELECT src, count(*) AS n, min(round(w, 2)) AS least FROM e JOIN m USING (src) WHERE w > 0.001 * top GROUP BY 1""",
    "sorted_by_year": f"WITH {RANKED} SELECT node, year, citations, rank, CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, rank) AS INTEGER) AS place FROM r",
    "sorted_by_citations": f"WITH {RANKED} SELECT node, year, citations, rank, CAST(row_number() OVER (ORDER BY citations, rank) AS INTEGER) AS place FROM r",
    "first_seen": "SELECT CAST(row_number() OVER (ORDER BY seen) AS INTEGER) AS place, l_partkey FROM (SELECT l_partkey, min((l_orderkey, l_linenumber, l_partkey)) AS seen FROM lineitem GROUP BY 1)",
    "topic_pattern": f"WITH {CORPUS} SELECT id, in_corpus_cited_by FROM works WHERE NOT is_stub AND id IN (SELECT work_id FROM wt WHERE e ILIKE 'Tbrand#1%') ORDER BY in_corpus_cited_by DESC, id LIMIT 25",
    "shown_works": "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'user_upload' ELSE 'openalex' END AS source FROM part WHERE p_size % 7 <> 0 OR p_partkey % 3 = 1",
    "listed_references": "SELECT p_partkey, CAST(CASE WHEN p_size % 9 = 0 THEN 0 ELSE least(p_size % 6, 5) END AS INTEGER) AS n_references FROM part",
}
