"""Driver queries of profile and paper pages, state changes and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import corpus, graph, pages, rank, resample, score, search, state, traverse
from quillgraph.plans.lineage import cut
from quillgraph.plans.oracles import CORPUS, EDGES, TRIGRAMS
from quillgraph.plans.queries import _misspelt, _read, _round, _titles
from quillgraph.sources import testdata


def _profile(spark, sf_dir):
    """A corpus, its works with counts, and the trust list of the examples, each written once."""
    c = testdata.read(spark, sf_dir).stored()
    works = cut(c.works, "works")
    return c, works, cut(testdata.trust_set(works), "trust")


def paper_detail(spark, sf_dir):
    return _round(pages.paper_detail(*_profile(spark, sf_dir)), "citation_pct", "corpus_pct", "disagreement")


def trust_list(spark, sf_dir):
    _, works, trust = _profile(spark, sf_dir)
    return pages.trust_list(trust, works, "pos")


def trust_diversity(spark, sf_dir):
    c, _, trust = _profile(spark, sf_dir)
    return rank.entropy(pages.trust_observations(trust, c), "dimension", "category")


def trust_echo(spark, sf_dir):
    return _round(rank.echo(trust_diversity(spark, sf_dir)), "diversity", "echo", digits=6)


def hop_distance(spark, sf_dir):
    c, works, trust = _profile(spark, sf_dir)
    return traverse.hops(c.citations, trust.select(F.col("work_id").alias("node")), works)


def adjacency_scores(spark, sf_dir):
    c, _, trust = _profile(spark, sf_dir)
    nodes = trust.select(F.col("work_id").alias("node"))
    return _round(score.adjacency(graph.around(c, nodes), nodes, []), "score")


def relation_counts(spark, sf_dir):
    c = testdata.read(spark, sf_dir).stored()
    return pages.relation_counts(cut(graph.build(c), "edges"))


def integrity(spark, sf_dir):
    c = testdata.read(spark, sf_dir).stored()
    return pages.integrity(c.works_base, c.citations)


def _two_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Full papers by their citations in the corpus, and by all their citations."""
    _, works, _ = _profile(spark, sf_dir)
    nodes = works.where("not is_stub").withColumnRenamed("id", "node")
    return cut(resample.ranked(nodes, "in_corpus_cited_by")), cut(resample.ranked(nodes, "cited_by_count"))


def top_churn(spark, sf_dir):
    return rank.top_churn(*_two_lists(spark, sf_dir), k=50)


def list_overlap(spark, sf_dir):
    from quillgraph.operators import evaluate

    a, b = _two_lists(spark, sf_dir)
    return _round(evaluate.overlap(a, b, 50), "jaccard", "shared")


def recent_page(spark, sf_dir):
    """Ranks 11 to 35 by citations of the papers of 1990 to 2005, the ranks those of the full list."""
    _, works, _ = _profile(spark, sf_dir)
    found = resample.ranked(works.where("not is_stub").withColumnRenamed("id", "node").select("node", "cited_by_count"), "cited_by_count")
    return rank.page(rank.year_filter(found, works, 1990, 2005), 10, 25)


def _refs(spark, sf_dir) -> DataFrame:
    """(ref, raw, title, year): every part as a reference by DOI, by arXiv number, or by neither."""
    p = _read(spark, sf_dir, "part")
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    raw = F.when(kind == 0, F.concat(F.lit("A. B. Title. doi:10.1234/Part."), key, F.lit("."))).when(kind == 1, F.concat(F.lit("Title. arXiv:2101."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))).otherwise(F.lit("No identifier at all."))
    return p.select(F.col("p_partkey").alias("ref"), raw.alias("raw"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"))


def match_references(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    arxiv = F.concat(F.lit("https://doi.org/10.48550/arXiv.2101."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))
    doi = F.when(F.col("p_partkey") % 3 == 1, arxiv).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1234/part."), F.col("p_partkey").cast("string")))
    works = p.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("year"), doi.alias("doi"))
    return search.match_references(_refs(spark, sf_dir), works)


def self_citations(spark, sf_dir):
    """Works that share an author with those of the first five authors by id."""
    c = testdata.read(spark, sf_dir)
    own = c.work_authors.where("author_id in ('A1', 'A2', 'A3', 'A4', 'A5')").select("author_id")
    return search.self_citations(own, c.work_authors.select("work_id", "author_id"))


def search_with_fallback(spark, sf_dir):
    """Titles of parts asked for as they are (even keys) or misspelt (odd keys)."""
    titles = _titles(spark, sf_dir)
    asked = _misspelt(spark, sf_dir).where("query % 2 = 1").select("query", "text").unionByName(titles.where("id % 2 = 0").select(F.col("id").alias("query"), F.col("title").alias("text")))
    index = search.postings(titles.select("id", "title", F.lit("").alias("body")))
    return _round(pages.find(index, titles, asked), "score")


def _upload(spark, sf_dir, first: int, last: int, upload: int) -> DataFrame:
    """Parts as references of an upload, accepted at strength 1 to 5; each fifth cites its own author."""
    p = _read(spark, sf_dir, "part").where(F.col("p_partkey").between(first, last))
    return p.select(F.lit(upload).cast("long").alias("upload_id"), F.col("p_partkey").alias("idx"), F.concat(F.lit("P"), "p_partkey").alias("work_id"), F.when(F.col("p_size") > 40, "reject").otherwise("accept").alias("decision"), (F.col("p_partkey") % 5 + 1).cast("int").alias("strength"), (F.col("p_partkey") % 5 == 0).alias("is_self_citation"))


def _two_uploads(spark, sf_dir) -> dict[str, DataFrame]:
    trust = spark.createDataFrame([("P3", 4, False), ("P8", 2, False)], "work_id string, strength int, is_distrust boolean")
    sources = spark.createDataFrame([], "work_id string, upload_id long, created_trust boolean")
    citations = spark.createDataFrame([], "src_id string, dst_id string")
    one = state.confirm(trust, sources, citations, _upload(spark, sf_dir, 1, 60, 1), 1, "CL1")
    return state.confirm(one["trust"], one["sources"], one["citations"], _upload(spark, sf_dir, 41, 90, 2), 2, "CL2")


def trust_after_uploads(spark, sf_dir):
    return _two_uploads(spark, sf_dir)["trust"]


def trust_after_undo(spark, sf_dir):
    s = _two_uploads(spark, sf_dir)
    return state.undo(s["trust"], s["sources"], s["citations"], 1, "CL1")["trust"]


def upload_counters(spark, sf_dir):
    refs = _upload(spark, sf_dir, 1, 60, 1).unionByName(_upload(spark, sf_dir, 41, 90, 2)).withColumn("work_id", F.when(F.col("strength") < 5, F.col("work_id")))
    return state.counters(refs)


def merged_records(spark, sf_dir):
    """Parts as full and stub records of one id, merged, then updated for each seventh key."""
    p = _read(spark, sf_dir, "part")
    full = p.where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(False).alias("is_stub"))
    stub = p.where("p_size >= 20").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.lit(True).alias("is_stub"))
    have = corpus.first_per_key(full.unionByName(stub), ["id"], [F.col("is_stub")])
    return corpus.upsert(have, p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), F.lit(False).alias("is_stub")), ["id"])


def trust_changes(spark, sf_dir):
    """Each third trusted part taken away, each fifth at strength 5, and some that are new."""
    trust = _read(spark, sf_dir, "part").where("p_size < 20").select(F.concat(F.lit("P"), "p_partkey").alias("work_id"), (F.col("p_size") % 5 + 1).cast("int").alias("strength"), F.lit(False).alias("is_distrust"))
    p = _read(spark, sf_dir, "part").where("p_partkey % 3 = 0 or p_partkey % 5 = 0")
    changes = p.select(F.concat(F.lit("P"), "p_partkey").alias("work_id"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(5).alias("strength"), F.lit(False).alias("is_distrust"))
    return state.set_trust(trust, changes)


def words_for_scores(spark, sf_dir):
    """The words and labels that stand for numbers, over parts."""
    p = _read(spark, sf_dir, "part")
    x = (F.col("p_partkey") % 21) / 20.0
    delta = F.col("p_size") - 25
    return p.select("p_partkey", tx.verdict(F.col("p_size") / 10.0, (F.col("p_partkey") % 13) / 10.0).alias("verdict"), tx.disagreement_band(x).alias("differs"), tx.novelty_word(x).alias("novelty"), tx.ordinal(F.col("p_partkey")).alias("ordinal"), tx.signed_rank(delta).alias("moved"), tx.without_pages(F.concat("p_name", F.lit(", pp. "), F.col("p_size").cast("string"), F.lit("-99."))).alias("title"), tx.short_id(F.concat(F.lit("https://example.org/W"), F.col("p_partkey").cast("string"))).alias("short"))


QUERIES = {
    f.__name__: f
    for f in (
        paper_detail, trust_list, trust_diversity, trust_echo, hop_distance, adjacency_scores, relation_counts, integrity, top_churn, list_overlap, recent_page,
        match_references, self_citations, search_with_fallback, trust_after_uploads, trust_after_undo, upload_counters, merged_records, trust_changes, words_for_scores,
    )
}

TRUSTED = """
trust AS MATERIALIZED (
  SELECT id AS work_id, CAST((pos - 1) % 5 + 1 AS INTEGER) AS strength, pos
  FROM (SELECT id, row_number() OVER (ORDER BY in_corpus_cited_by DESC, id) AS pos FROM works WHERE NOT is_stub) WHERE pos <= 6
)"""
NAMES = """
names AS (SELECT 'T' || p_brand AS id, p_brand AS name FROM part WHERE p_size <= 45 GROUP BY ALL UNION ALL SELECT 'I' || n_nationkey, n_name FROM nation)"""
DIVERSITY = f"""{CORPUS}, {TRUSTED},
obs AS (
  SELECT 'topic' AS dimension, e AS category FROM wt JOIN trust USING (work_id) UNION ALL SELECT 'venue', e FROM wv JOIN trust USING (work_id)
  UNION ALL SELECT 'institution', e FROM wi JOIN trust USING (work_id) UNION ALL SELECT 'decade', CAST(year // 10 * 10 AS VARCHAR) || 's' FROM base JOIN trust ON work_id = id WHERE year IS NOT NULL
),
counts AS (SELECT dimension, category, count(*) AS n FROM obs GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS share FROM counts),
h AS (SELECT dimension, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_categories, -sum(share * ln(share)) AS entropy FROM shares GROUP BY 1),
w AS (SELECT *, CASE WHEN least(n_obs, n_categories) > 1 THEN ln(least(n_obs, n_categories)) ELSE 0 END AS most FROM h),
diversity AS (SELECT dimension, n_obs, n_categories, round(entropy, 9) AS entropy, round(most, 9) AS most, round(CASE WHEN most > 0 THEN round(entropy, 9) / round(most, 9) ELSE 0 END, 9) AS normalised FROM w)"""
LISTS = f"""{CORPUS},
a AS (SELECT id, row_number() OVER (ORDER BY in_corpus_cited_by DESC, id) AS r FROM works WHERE NOT is_stub QUALIFY r <= 50),
b AS (SELECT id, row_number() OVER (ORDER BY cited_by_count DESC, id) AS r FROM works WHERE NOT is_stub QUALIFY r <= 50)"""
HOPS = """
links AS MATERIALIZED (SELECT src_id AS a, dst_id AS b FROM cit UNION SELECT dst_id, src_id FROM cit),
l0 AS (SELECT work_id AS node FROM trust), l1 AS MATERIALIZED (SELECT DISTINCT b AS node FROM links JOIN l0 ON a = node),
l2 AS MATERIALIZED (SELECT DISTINCT b AS node FROM links JOIN l1 ON a = node), l3 AS MATERIALIZED (SELECT DISTINCT b AS node FROM links JOIN l2 ON a = node)"""
UPLOADS = """
refs AS (SELECT p_partkey AS k, 'P' || p_partkey AS work_id, CAST(p_partkey % 5 + 1 AS INTEGER) AS strength FROM part WHERE p_size <= 40 AND p_partkey % 5 <> 0),
old AS (SELECT * FROM (VALUES ('P3', 4), ('P8', 2)) t(work_id, strength)),
one AS (SELECT work_id, strength FROM refs WHERE k BETWEEN 1 AND 60 AND work_id NOT IN (SELECT work_id FROM old)),
two AS (SELECT work_id, strength FROM refs WHERE k BETWEEN 41 AND 90 AND work_id NOT IN (SELECT work_id FROM old) AND work_id NOT IN (SELECT work_id FROM one))"""

ORACLES = {
    "paper_detail": f"""WITH {CORPUS}, {TRUSTED}, {NAMES},
t AS (SELECT work_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS topics FROM wt JOIN names ON id = e GROUP BY 1),
i AS (SELECT work_id, string_agg(DISTINCT name, '; ' ORDER BY name) AS institutions FROM wi JOIN names ON id = e GROUP BY 1),
f AS (SELECT id, title, cume_dist() OVER (ORDER BY cited_by_count) AS x, cume_dist() OVER (ORDER BY in_corpus_cited_by) AS y FROM works WHERE NOT is_stub)
SELECT id AS node, title, coalesce(topics, '') AS topics, coalesce(institutions, '') AS institutions, round(x, 9) AS citation_pct, round(y, 9) AS corpus_pct, round(abs(x - y), 9) AS disagreement, strength
FROM f LEFT JOIN t ON t.work_id = id LEFT JOIN i ON i.work_id = id LEFT JOIN trust ON trust.work_id = id""",
    "trust_list": f"""WITH {CORPUS}, {TRUSTED} SELECT CAST(row_number() OVER (ORDER BY pos DESC) AS INTEGER) AS place, work_id, strength, false AS is_distrust, title, CAST(year AS INTEGER) AS year FROM trust JOIN base ON id = work_id""",
    "trust_diversity": f"WITH {DIVERSITY} SELECT * FROM diversity",
    "trust_echo": f"""WITH {DIVERSITY}, m AS (SELECT round(avg(normalised), 9) AS diversity FROM diversity), e AS (SELECT diversity, round(greatest(0, least(1, 1 - diversity)), 9) AS echo FROM m)
SELECT round(diversity, 6) AS diversity, round(echo, 6) AS echo, CASE WHEN echo >= 0.7 THEN 'narrow' WHEN echo >= 0.4 THEN 'mixed' ELSE 'broad' END AS band FROM e""",
    "hop_distance": f"""WITH {CORPUS}, {TRUSTED}, {HOPS}
SELECT id AS node, CAST(CASE WHEN id IN (FROM l0) THEN 0 WHEN id IN (FROM l1) THEN 1 WHEN id IN (FROM l2) THEN 2 WHEN id IN (FROM l3) THEN 3 ELSE 99 END AS INTEGER) AS hops FROM works""",
    "adjacency_scores": f"WITH {EDGES} SELECT dst AS node, round(max(edges.weight), 9) AS score FROM edges JOIN trust ON work_id = src GROUP BY 1",
    "relation_counts": f"""WITH {EDGES}, ends AS (SELECT context, relation, src AS node FROM edges UNION ALL SELECT context, relation, dst FROM edges),
n AS (SELECT context, relation, count(DISTINCT node) AS n_nodes FROM ends GROUP BY ALL), m AS (SELECT context, relation, count(*) AS n_edges FROM edges GROUP BY ALL)
SELECT context, relation, n_edges, n_nodes FROM m JOIN n USING (context, relation)""",
    "integrity": f"""WITH {CORPUS} SELECT (SELECT count(*) - count(DISTINCT id) FROM base) AS n_repeated_ids, (SELECT count(*) FROM base WHERE year IS NULL) AS n_without_year,
(SELECT count(*) FROM base WHERE NOT is_stub AND venue_id IS NULL) AS n_without_venue,
(SELECT count(*) FROM cit WHERE src_id NOT IN (SELECT id FROM base) OR dst_id NOT IN (SELECT id FROM base)) AS n_dangling, (SELECT count(*) FROM cit WHERE src_id = dst_id) AS n_self""",
    "top_churn": f"WITH {LISTS} SELECT id AS node, 'entered' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'left' FROM a WHERE id NOT IN (SELECT id FROM b)",
    "list_overlap": f"""WITH {LISTS}, k AS (SELECT count(*) AS n FROM a JOIN b USING (id)), u AS (SELECT count(*) AS n FROM (SELECT id FROM a UNION SELECT id FROM b))
SELECT round(k.n / u.n, 9) AS jaccard, round(k.n / 50, 9) AS shared FROM k, u""",
    "recent_page": f"""WITH {CORPUS}, r AS (SELECT id AS node, cited_by_count, CAST(row_number() OVER (ORDER BY cited_by_count DESC, id) AS INTEGER) AS rank, year FROM works WHERE NOT is_stub)
SELECT node, cited_by_count, rank FROM r WHERE year BETWEEN 1990 AND 2005 AND rank BETWEEN 11 AND 35""",
    "match_references": """WITH x AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'doi' WHEN p_partkey % 3 = 1 THEN 'arxiv' ELSE 'none' END AS method FROM part),
first AS (SELECT p_partkey % 100000 AS k, min('P' || p_partkey) AS work_id FROM part WHERE p_partkey % 3 = 1 GROUP BY 1)
SELECT ref, CASE method WHEN 'doi' THEN 'P' || ref WHEN 'arxiv' THEN first.work_id END AS work_id, method, CAST(CASE WHEN method = 'none' THEN 0 ELSE 1 END AS DOUBLE) AS confidence, CASE WHEN method = 'none' THEN 'pending' ELSE 'accept' END AS decision
FROM x LEFT JOIN first ON method = 'arxiv' AND k = ref % 100000""",
    "self_citations": f"WITH {CORPUS} SELECT work_id, bool_or(e IN ('A1', 'A2', 'A3', 'A4', 'A5')) AS is_self FROM wa GROUP BY 1",
    "search_with_fallback": f"""WITH {TRIGRAMS}, words AS (SELECT id, unnest([x FOR x IN regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']) AS term FROM t),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
asked AS (SELECT id AS query, CASE WHEN id % 2 = 1 THEN translate(title, 'a', 'o') ELSE title END AS text FROM t),
q AS MATERIALIZED (SELECT DISTINCT query, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']) AS term FROM asked),
hits AS MATERIALIZED (SELECT query, h.id, s FROM (SELECT query, id, count(*) AS met, sum(ln(1 + tf)) AS s FROM q JOIN tf USING (term) GROUP BY ALL) h JOIN (SELECT query, count(*) AS needed FROM q GROUP BY 1) USING (query) WHERE met = needed),
near AS (SELECT query, id, round(s, 9) AS s FROM sim WHERE s >= 0.2 AND query % 2 = 1 AND query NOT IN (SELECT query FROM hits) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) = 1)
SELECT query, id, 'text' AS method, round(s, 9) AS score FROM hits UNION ALL SELECT query, id, 'title', s FROM near""",
    "trust_after_uploads": f"WITH {UPLOADS} SELECT work_id, strength, false AS is_distrust FROM (FROM old UNION ALL FROM one UNION ALL FROM two)",
    "trust_after_undo": f"WITH {UPLOADS} SELECT work_id, strength, false AS is_distrust FROM (FROM old UNION ALL (SELECT * FROM one WHERE work_id IN (SELECT work_id FROM refs WHERE k BETWEEN 41 AND 90)) UNION ALL FROM two)",
    "upload_counters": """WITH r AS (SELECT 1 AS u, p_partkey AS k FROM part WHERE p_partkey BETWEEN 1 AND 60 UNION ALL SELECT 2, p_partkey FROM part WHERE p_partkey BETWEEN 41 AND 90)
SELECT CAST(u AS BIGINT) AS upload_id, count(*) AS n_parsed, count(*) FILTER (k % 5 < 4) AS n_matched, count(*) FILTER (k % 5 = 4) AS n_unresolved FROM r GROUP BY 1""",
    "merged_records": """WITH have AS (SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN p_name ELSE p_type END AS title, p_size > 25 AS is_stub FROM part)
SELECT id, title, is_stub FROM have WHERE id % 7 <> 0 UNION ALL SELECT p_partkey, upper(p_name), false FROM part WHERE p_partkey % 7 = 0""",
    "trust_changes": """SELECT 'P' || p_partkey AS work_id, CAST(CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE p_size % 5 + 1 END AS INTEGER) AS strength, false AS is_distrust FROM part
WHERE p_partkey % 3 <> 0 AND (p_size < 20 OR p_partkey % 5 = 0)""",
    "words_for_scores": """WITH v AS (SELECT *, (p_partkey % 13) / p_size AS rel, (p_partkey % 21) / 20 AS x, p_partkey % 100 AS ten, p_partkey % 10 AS one, p_size - 25 AS d FROM part)
SELECT p_partkey, CASE WHEN rel < 0.15 THEN 'tight' WHEN rel < 0.5 THEN 'loose' ELSE 'uninformative' END AS verdict,
  CASE WHEN x < 0.2 THEN 'agree' WHEN x < 0.45 THEN 'lean' WHEN x < 0.7 THEN 'differ' ELSE 'split' END AS differs,
  CASE WHEN x <= 0.25 THEN 'close' WHEN x <= 0.5 THEN 'near' WHEN x <= 0.75 THEN 'far' ELSE 'remote' END AS novelty,
  p_partkey || CASE WHEN ten BETWEEN 11 AND 13 THEN 'th' WHEN one = 1 THEN 'st' WHEN one = 2 THEN 'nd' WHEN one = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  CASE WHEN d = 0 THEN 'no change' WHEN d > 0 THEN '+' || d ELSE CAST(d AS VARCHAR) END AS moved, p_name AS title, 'W' || p_partkey AS short FROM v""",
}
