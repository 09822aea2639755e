"""The driver's queries over the synthetic text tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import alignment, decontaminate, langid, mixing, neighbours, ngram_join, quality, quantiles, substring_dedup, suffix_dedup, topk, toxicity, url_filter

# The rules of op8 as (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text modulo n; null without an id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def _held_out(df: DataFrame, n: int, remainder: int, columns: str) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(_remainder(n) == remainder, F.lit(False))).select("doc_id", "held_out", *columns.split())


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, most=3.0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"), learned=_remainder(3) != 1)
    return _held_out(found, 3, 1, "lang_pred score rejected")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(_read(spark, sf_dir, "documents"), n=13)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = _read(spark, sf_dir, "labels").where(_remainder(4) != 2)
    return _held_out(quality.classify(_read(spark, sf_dir, "documents"), learned, "quality", threshold=0.7), 4, 2, "score predicted")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_read(spark, sf_dir, "documents"), length=400)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=13, coverage=0.05)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = _read(spark, sf_dir, "labels").where(_remainder(5) != 0)
    return _held_out(toxicity.classify(_read(spark, sf_dir, "documents"), learned, "toxic", threshold=0.5), 5, 0, "score predicted")


#: The public tokenizers' files, at the same place on every machine.
TOKENIZERS = "/opt/tokenizers"


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_mergeable_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantiles.streams_of(*(_read(spark, sf_dir, name) for name in ("clicks", "sale_lines", "items")))
    return quantiles.stream_quantiles(quantiles.batched(rows, 4), batches=4, points=200, least=10, most=1000, parts=4, least_rows=20, per_mille=20)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_mergeable_quantiles": op13_mergeable_quantiles,
}

ORACLES = {
    "op4_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), g AS (
  SELECT doc_id, ws, len(ws) AS n FROM w
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, n - 11)) AS i FROM g WHERE n >= 13)
), bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM win) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM bad, (SELECT unnest(range(0, 13)) AS j)
), lost AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT g.doc_id, CAST(g.n AS BIGINT) AS n_words, CAST(coalesce(lost.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN lost.ps IS NULL THEN ws
         ELSE [ws[p] FOR p IN range(1, n + 1) IF NOT list_contains(lost.ps, p)] END, ' '), '')) AS kept_sha256
FROM g LEFT JOIN lost USING (doc_id)
""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_url_filter": r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), f AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
""",
    "op9_decontaminate": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS k
  FROM (SELECT item_id, ws, least(len(ws), 13) AS l, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sizes AS (
  SELECT DISTINCT l FROM win
), dg AS (
  SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS k
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM dw, sizes WHERE len(ws) >= l)
), occ AS (
  SELECT doc_id, dg.l AS l, i, item_id FROM dg JOIN win ON dg.k = win.k AND dg.l = win.l
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op13_mergeable_quantiles": """
WITH tab AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(k))
), ids AS (
  SELECT DISTINCT id FROM (SELECT click_id AS id FROM clicks UNION ALL SELECT vendor_id FROM sale_lines)
), crc AS (
  SELECT id, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(coalesce(CAST(id AS VARCHAR), ''), '') IF ch <> '']),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) % 4 AS INTEGER) AS batch
  FROM ids, tab
), src AS (
  SELECT 'value' AS stream, CAST(client_id AS VARCHAR) AS grp, click_id AS id, value AS money
  FROM (SELECT DISTINCT click_id, client_id, value FROM clicks)
  UNION ALL
  SELECT 'price', brand, vendor_id, price FROM sale_lines JOIN items USING (item_id)
), x AS (
  SELECT stream, grp, batch, CAST(floor(100 * money + 0.5) AS BIGINT) + 1000 * batch AS x
  FROM src JOIN crc ON src.id IS NOT DISTINCT FROM crc.id WHERE grp IS NOT NULL AND money IS NOT NULL AND isfinite(money)
), c AS (
  SELECT stream, grp, batch, x, count(*) AS c FROM (SELECT * FROM x UNION ALL SELECT stream, grp, -1, x FROM x) GROUP BY ALL
), k AS (
  SELECT *, CAST(sum(c) OVER (PARTITION BY stream, grp, batch ORDER BY x) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY stream, grp, batch) AS BIGINT) AS n,
    row_number() OVER (PARTITION BY stream, grp, batch ORDER BY x) AS ord, count(*) OVER (PARTITION BY stream, grp, batch) AS d
  FROM c
), p AS (
  SELECT stream, grp, batch, x, upto - c AS below, upto, n FROM k
  WHERE batch >= 0 AND (upto = c OR upto * 200 // n > (upto - c) * 200 // n OR ord * 10 // d > (ord - 1) * 10 // d)
), grid AS (
  SELECT stream, grp, x, batch, n FROM (SELECT DISTINCT stream, grp, x FROM p) JOIN (SELECT DISTINCT stream, grp, batch, n FROM p) USING (stream, grp)
), held AS (
  SELECT g.*, p.below, p.upto,
    coalesce(last_value(p.upto IGNORE NULLS) OVER (PARTITION BY g.stream, g.grp, g.batch ORDER BY g.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
    coalesce(first_value(p.below IGNORE NULLS) OVER (PARTITION BY g.stream, g.grp, g.batch ORDER BY g.x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), g.n) AS hi
  FROM grid g LEFT JOIN p ON p.stream = g.stream AND p.grp = g.grp AND p.batch = g.batch AND p.x = g.x
), s AS (
  SELECT stream, grp, -1 AS batch, x, sum(coalesce(below, hi)) AS bh, sum(coalesce(upto, lo)) AS ul, sum(n) AS n FROM held GROUP BY stream, grp, x
  UNION ALL SELECT stream, grp, batch, x, below, upto, n FROM p
), t AS (
  SELECT *, (i * n + 3) // 4 AS target FROM s, (SELECT unnest([1, 2, 3]) AS i) WHERE n >= 20
), a AS (
  SELECT stream, grp, batch, i, n, target, count(*) AS points, min({'bound': greatest(0, bh + 1 - target, target - ul), 'x': x}) AS best FROM t GROUP BY ALL
)
SELECT a.stream, a.grp, CAST(a.batch AS INTEGER) AS batch, CAST(a.i AS INTEGER) AS i, CAST(a.n AS BIGINT) AS n, CAST(a.target AS BIGINT) AS target,
  e.x AS exact_x, a.points, a.best.x AS answer, w.upto - w.c AS n_below, w.upto AS n_upto,
  CAST(greatest(0, w.upto - w.c + 1 - a.target, a.target - w.upto) AS BIGINT) AS rank_error,
  1000 * greatest(0, w.upto - w.c + 1 - a.target, a.target - w.upto) <= 20 * a.n AS within, CAST(a.best.bound AS BIGINT) AS bound
FROM a JOIN k w ON w.stream = a.stream AND w.grp = a.grp AND w.batch = a.batch AND w.x = a.best.x
JOIN k e ON e.stream = a.stream AND e.grp = a.grp AND e.batch = a.batch AND e.upto >= a.target AND e.upto - e.c < a.target
""",
}
