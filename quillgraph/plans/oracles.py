"""DuckDB SQL for the driver's queries, written independently of the DataFrame plans."""

from __future__ import annotations

from quillgraph.functions import porter

# The weights used below are those of schema.RELATION_WEIGHTS and schema.STRENGTHS.

CORPUS = """
cit AS MATERIALIZED (SELECT DISTINCT 'C' || o_custkey AS src_id, 'P' || l_partkey AS dst_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
base AS MATERIALIZED (
  SELECT 'P' || p_partkey AS id, p_name AS title, 1970 + p_size AS year, p_size > 45 AS is_stub, CASE WHEN p_size <= 45 THEN 'V' || p_type END AS venue_id,
         CAST(coalesce(q, 0) AS BIGINT) AS cited_by_count
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  UNION ALL
  SELECT 'C' || c_custkey, c_name, y, false, NULL, 0 FROM customer LEFT JOIN (SELECT o_custkey, year(min(o_orderdate)) AS y FROM orders GROUP BY 1) ON o_custkey = c_custkey
),
works AS MATERIALIZED (
  SELECT base.*, coalesce(r.n, 0) AS ref_count, coalesce(i.n, 0) AS in_corpus_cited_by FROM base
  LEFT JOIN (SELECT src_id, count(*) AS n FROM cit GROUP BY 1) r ON r.src_id = base.id
  LEFT JOIN (SELECT dst_id, count(*) AS n FROM cit GROUP BY 1) i ON i.dst_id = base.id
),
wa0 AS MATERIALIZED (
  SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS i
  FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1, 2)
),
wa AS MATERIALIZED (SELECT 'P' || l_partkey AS work_id, 'A' || l_suppkey AS e, i - 1 AS position FROM wa0 WHERE i <= 3),
wt AS MATERIALIZED (SELECT 'P' || p_partkey AS work_id, 'T' || p_brand AS e FROM part WHERE p_size <= 45),
wv AS MATERIALIZED (SELECT id AS work_id, venue_id AS e FROM base WHERE venue_id IS NOT NULL),
wi AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS work_id, 'I' || s_nationkey AS e FROM wa0 JOIN supplier ON s_suppkey = l_suppkey WHERE i <= 3),
authors AS (SELECT e, count(DISTINCT work_id) AS deg FROM wa GROUP BY 1),
topics AS (SELECT e, deg, greatest(0.01, ln((SELECT count(*) FROM base WHERE NOT is_stub) / (1 + deg))) AS idf FROM (SELECT e, count(DISTINCT work_id) AS deg FROM wt GROUP BY 1)),
venues AS (SELECT e, count(DISTINCT work_id) AS deg FROM wv GROUP BY 1),
institutions AS (SELECT e, count(DISTINCT work_id) AS deg FROM wi GROUP BY 1)
"""

AGED = """
aged AS (SELECT src_id, dst_id, CASE WHEN year IS NULL OR year = 0 THEN 1.0 ELSE greatest(0.4, pow(0.5, greatest(0, 2026 - year) / 60.0)) END AS f FROM cit JOIN base ON id = dst_id),
cites AS MATERIALIZED (
  SELECT src_id AS src, dst_id AS dst, 1.0 * f AS weight, 'citation' AS context, 'cites' AS relation, 0 AS place FROM aged
  UNION ALL SELECT dst_id, src_id, 0.15 * f, 'citation', 'cited_by', 1 FROM aged
)
"""


def _family(links: str, entities: str, context: str, out: str, back: str, weight: float, place: int, scale: str = "1.0") -> str:
    rows = f"FROM {links} l JOIN (SELECT * FROM {entities} WHERE deg > 1) d ON d.e = l.e"
    return f"""SELECT work_id AS src, l.e AS dst, {weight} * {scale} AS weight, '{context}' AS context, '{out}' AS relation, {place} AS place {rows}
  UNION ALL SELECT l.e, work_id, {weight} * {scale} / sqrt(greatest(deg, 1)), '{context}', '{back}', {place + 1} {rows}"""


ENTITY = f"""
top_topics AS (SELECT *, max(idf) OVER () AS top_idf FROM topics WHERE deg > 1),
entity AS MATERIALIZED (
  {_family("wa", "authors", "author", "authored_by", "wrote", 0.6, 2)}
  UNION ALL {_family("wt", "top_topics", "topic", "tagged", "tags", 0.2, 8, "(idf / top_idf)")}
  UNION ALL {_family("wv", "venues", "venue", "published_in", "publishes", 0.15, 6)}
  UNION ALL {_family("wi", "institutions", "institution", "affiliated", "hosts", 0.1, 10)}
)
"""

COUPLED = """
deg AS (SELECT dst_id, count(*) AS n FROM cit GROUP BY 1),
kept AS MATERIALIZED (SELECT c.* FROM cit c JOIN deg USING (dst_id) WHERE n BETWEEN 2 AND 200),
cn AS MATERIALIZED (SELECT x.src_id AS a, y.src_id AS b, count(*) AS n FROM kept x JOIN kept y ON x.dst_id = y.dst_id AND x.src_id < y.src_id GROUP BY ALL HAVING count(*) >= 3),
alln AS (SELECT x.src_id AS a, y.src_id AS b, count(*) AS n FROM cit x JOIN cit y ON x.dst_id = y.dst_id AND x.src_id < y.src_id GROUP BY ALL),
cp AS MATERIALIZED (
  SELECT cn.a, cn.b, round(CAST(0.35 AS DOUBLE) * cn.n / (ra.ref_count + rb.ref_count - alln.n), 12) AS weight FROM cn JOIN alln ON alln.a = cn.a AND alln.b = cn.b JOIN works ra ON ra.id = cn.a JOIN works rb ON rb.id = cn.b
)"""
COCITED = """
few AS (SELECT src_id FROM cit GROUP BY 1 HAVING count(*) <= 200),
ckept AS MATERIALIZED (SELECT * FROM cit WHERE src_id IN (SELECT src_id FROM few)),
ccn AS MATERIALIZED (SELECT x.dst_id AS a, y.dst_id AS b, count(*) AS n FROM ckept x JOIN ckept y ON x.src_id = y.src_id AND x.dst_id < y.dst_id GROUP BY ALL),
cc AS MATERIALIZED (SELECT a, b, round(CAST(0.30 AS DOUBLE) * ln(1 + n) / ln(1 + (SELECT max(n) FROM ccn)), 12) AS weight FROM ccn WHERE n >= 3)"""
COUPLING = f"{CORPUS}, {COUPLED}"
NEAREST = f"""{COUPLED}, {COCITED},
e1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS i FROM (SELECT a, b, weight FROM cp UNION ALL SELECT b, a, weight FROM cp)),
e2 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS i FROM (SELECT a, b, weight FROM cc UNION ALL SELECT b, a, weight FROM cc)),
similar_edges AS MATERIALIZED (
  SELECT a AS src, b AS dst, weight, 'citation' AS context, 'couples' AS relation, 4 AS place FROM e1 WHERE i <= 15
  UNION ALL SELECT a, b, weight, 'citation', 'co_cited', 5 FROM e2 WHERE i <= 15
)
"""

EDGES = f"""{CORPUS}, {AGED}, {ENTITY}, {NEAREST},
edges AS MATERIALIZED (
  SELECT src, dst, max(weight) AS weight, context, arg_max(relation, (weight, -place)) AS relation
  FROM (SELECT * FROM cites UNION ALL SELECT * FROM entity UNION ALL SELECT * FROM similar_edges) GROUP BY src, dst, context
),
trust AS MATERIALIZED (
  SELECT id AS work_id, CAST((pos - 1) % 5 + 1 AS INTEGER) AS strength, pos, [0.2, 0.45, 0.7, 1.0, 1.4][CAST((pos - 1) % 5 + 1 AS INTEGER)] AS weight
  FROM (SELECT id, row_number() OVER (ORDER BY in_corpus_cited_by DESC, id) AS pos FROM works WHERE NOT is_stub) WHERE pos <= 6
)
"""

D = "d AS MATERIALIZED (SELECT a.src AS node, sum(a.p * b.p) AS back FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"
P = f"""
w2 AS (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY 1, 2),
p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w2),
{D}
"""


def diffuse(name: str, seeds: str, keys: tuple[str, ...] = (), on: tuple[str, ...] = (), back: bool = False, absorb: bool = False, steps: int = 5, p: str = "p", d: str = "d", alpha: float = 0.85) -> str:
    """CTEs that end in ``name`` (*keys, node, score); ``seeds`` is a table (*keys, node, mass)."""
    k = "".join(f"{x}, " for x in keys)
    kx = "".join(f"x.{x}, " for x in keys)
    same = lambda a, b, cols: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols) or "true"
    out = [f"{name}0 AS MATERIALIZED (SELECT {k}node, mass FROM {seeds})"]
    for i in range(1, steps + 1):
        step = f"SELECT {kx}p.dst AS node, sum(x.mass * p.p) AS mass FROM {name}{i - 1} x JOIN {p} p ON p.src = x.node AND {same('p', 'x', on)} GROUP BY ALL"
        if back and i > 1:
            lost = f"SELECT {kx}x.node, x.mass * d.back AS lost FROM {name}{i - 2} x JOIN {d} d ON d.node = x.node AND {same('d', 'x', on)}"
            step = f"SELECT {''.join(f'y.{x}, ' for x in keys)}y.node, greatest(0, y.mass - coalesce(l.lost, 0)) AS mass FROM ({step}) y LEFT JOIN ({lost}) l ON l.node = y.node AND {same('l', 'y', keys)}"
        where = f" AND NOT EXISTS (SELECT 1 FROM {seeds} s WHERE s.node = z.node AND {same('s', 'z', keys)})" if absorb else ""
        out.append(f"{name}{i} AS MATERIALIZED (SELECT * FROM ({step}) z WHERE mass > 0{where})")
    union = " UNION ALL ".join(f"SELECT {k}node, mass * pow({alpha}, {i}) AS score FROM {name}{i}" for i in range(steps + 1))
    out.append(f"{name} AS MATERIALIZED (SELECT {k}node, sum(score) AS score FROM ({union}) GROUP BY ALL)")
    return ",\n".join(out)


def signed(name: str, seeds: str, keys: tuple[str, ...] = (), on: tuple[str, ...] = (), p: str = "p", d: str = "d") -> str:
    """CTEs that end in ``name`` (*keys, node, score); ``seeds`` is a table (*keys, node, weight)."""
    k = "".join(f"{x}, " for x in keys)
    over = f"PARTITION BY {', '.join(keys)}" if keys else ""
    same = " AND ".join(f"s.{c} = z.{c}" for c in keys) or "true"
    return f"""{name}_seeds AS MATERIALIZED (SELECT {k}CASE WHEN weight >= 0 THEN 1 ELSE -1 END AS sign, node, abs(weight) / sum(abs(weight)) OVER ({over}) AS mass FROM {seeds}),
{diffuse(name + "_k", name + "_seeds", (*keys, "sign"), on, True, True, 5, p, d)},
{name} AS MATERIALIZED (
  SELECT * FROM (SELECT {k}node, sum(score * sign) AS score FROM {name}_k z WHERE NOT EXISTS (SELECT 1 FROM {seeds} s WHERE s.node = z.node AND {same}) GROUP BY ALL) WHERE score <> 0
)"""


SEEDS = "seeds AS MATERIALIZED (SELECT work_id AS node, weight, weight / sum(weight) OVER () AS mass FROM trust)"
SHOWN = "NOT is_stub AND id NOT IN (SELECT work_id FROM trust)"
RANKING = f"""{EDGES}, {P}, {SEEDS}, {signed("sg", "seeds")},
ranking AS MATERIALIZED (SELECT node, round(score, 12) AS score FROM sg JOIN works ON id = node WHERE {SHOWN})"""
MERIT = f"""
gseeds AS MATERIALIZED (SELECT id AS node, 1.0 AS weight FROM works WHERE NOT is_stub ORDER BY in_corpus_cited_by DESC, id LIMIT 200),
{signed("gm", "gseeds")},
merit AS MATERIALIZED (SELECT node, round(score, 12) AS score FROM gm JOIN works ON id = node)"""

VIEWS = f"""
ve AS (SELECT v.view, src, dst, weight FROM edges, (SELECT unnest(['citation', 'author', 'topic', 'venue', 'institution']) AS view) v WHERE context = 'citation' OR context = v.view),
vw AS (SELECT view, src, dst, sum(weight) AS w FROM ve GROUP BY ALL),
vp AS MATERIALIZED (SELECT view, src, dst, w / sum(w) OVER (PARTITION BY view, src) AS p FROM vw),
vd AS MATERIALIZED (SELECT a.view, a.src AS node, sum(a.p * b.p) AS back FROM vp a JOIN vp b ON a.view = b.view AND a.src = b.dst AND a.dst = b.src GROUP BY ALL),
vseeds AS MATERIALIZED (SELECT view, node, weight FROM seeds, (SELECT DISTINCT view FROM vp))"""
CONTEXTS = f"{EDGES}, {SEEDS}, {VIEWS}, {signed('cs', 'vseeds', ('view',), ('view',), 'vp', 'vd')}"


def compose(name: str, scores: str, weights: dict[str, float], keys: tuple[str, ...] = ()) -> str:
    k = "".join(f"s.{x}, " for x in keys)
    w = ", ".join(f"('{c}', {x})" for c, x in weights.items() if x > 0)
    same = " AND ".join(["l.view = s.view", *(f"l.{x} = s.{x}" for x in keys)])
    return f"""{name} AS MATERIALIZED (
  SELECT {k}s.node, sum(w.weight * s.score) / sum(w.weight) AS score FROM {scores} s
  JOIN (SELECT {"".join(f"{x}, " for x in keys)}view FROM {scores} GROUP BY ALL HAVING count(*) > 1) l ON {same}
  JOIN (VALUES {w}) w(view, weight) ON w.view = s.view GROUP BY ALL
)"""


def _stats(name: str, table: str, column: str, where: str = "true") -> str:
    return f"""SELECT '{name}' AS family, count(*) AS n, min({column}) AS least, quantile_cont({column}, 0.5) AS median, round(avg({column}), 9) AS mean,
  quantile_cont({column}, 0.9) AS p90, quantile_cont({column}, 0.99) AS p99, max({column}) AS most FROM {table} WHERE {where}"""


def _neighbours(pairs: str, relation: str) -> str:
    return f"""SELECT a AS src, b AS dst, round(weight, 9) AS weight, 'citation' AS context, '{relation}' AS relation
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b DESC) AS i FROM (SELECT a, b, weight FROM {pairs} UNION ALL SELECT b, a, weight FROM {pairs})) WHERE i <= 15"""


UNITS = "units AS MATERIALIZED (SELECT work_id, strength, CASE WHEN pos <= 2 THEN 'u:1' WHEN pos = 3 THEN 'u:2' ELSE 'w:' || work_id END AS unit FROM trust)"

VOWELS = "list_reduce(list_prepend('', string_split(w, '')), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN ch = 'y' AND right(a, 1) = 'c' THEN 'v' WHEN ch = '' THEN '' ELSE 'c' END)"


def _stems(source: str) -> str:
    """CTEs that end in stem (word, stem) of the distinct words of ``source`` (term)."""

    def m(n: str) -> str:
        return f"(length(left(f, {n})) - length(replace(left(f, {n}), 'vc', ''))) // 2"

    def endings(rules: dict[str, str], least: int) -> str:
        whens = []
        for ending, other in sorted(rules.items(), key=lambda r: -len(r[0])):
            n = f"length(w) - {len(ending)}"
            ok = f"{m(n)} >= {least}" + (f" AND regexp_matches(left(w, {n}), '[st]$')" if ending == "ion" else "")
            whens.append(f"WHEN ends_with(w, '{ending}') THEN CASE WHEN {ok} THEN left(w, {n}) || '{other}' ELSE w END")
        return f"CASE {' '.join(whens)} ELSE w END"

    def mended(k: int) -> str:
        n = f"(length(w) - {k})"
        x, g = f"left(w, {n})", f"left(f, {n})"
        return f"""CASE WHEN NOT contains({g}, 'v') THEN w WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e'
  WHEN ends_with({g}, 'c') AND right({x}, 1) = right(left(w, {n} - 1), 1) AND {n} > 1 AND NOT regexp_matches({x}, '[lsz]$') THEN left(w, {n} - 1)
  WHEN {m(n)} = 1 AND ends_with({g}, 'cvc') AND NOT regexp_matches({x}, '[wxy]$') THEN {x} || 'e' ELSE {x} END"""

    one = "length(w) - 1"
    steps = [
        endings(porter.PLURALS, 0),
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {m('length(w) - 3')} > 0 THEN left(w, {one}) ELSE w END WHEN ends_with(w, 'ed') THEN {mended(2)} WHEN ends_with(w, 'ing') THEN {mended(3)} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND contains(left(f, {one}), 'v') THEN left(w, {one}) || 'i' ELSE w END",
        endings(porter.STEP_2, 1),
        endings(porter.STEP_3, 1),
        endings(dict.fromkeys(porter.STEP_4, ""), 2),
        f"CASE WHEN ends_with(w, 'e') AND ({m(one)} > 1 OR ({m(one)} = 1 AND NOT (ends_with(left(f, {one}), 'cvc') AND NOT regexp_matches(left(w, {one}), '[wxy]$')))) THEN left(w, {one}) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m('length(w)')} > 1 THEN left(w, {one}) ELSE w END",
    ]
    out = [f"sw AS MATERIALIZED (SELECT DISTINCT term AS word FROM {source})", f"s0 AS MATERIALIZED (SELECT word, w, {VOWELS} AS f FROM (SELECT word, word AS w FROM sw WHERE regexp_full_match(word, '[a-z]{{3,}}')))"]
    out += [f"s{i} AS MATERIALIZED (SELECT word, w, {VOWELS} AS f FROM (SELECT word, {step} AS w FROM s{i - 1}))" for i, step in enumerate(steps, 1)]
    return ",\n".join([*out, f"stem AS MATERIALIZED (SELECT sw.word, coalesce(s.w, sw.word) AS stem FROM sw LEFT JOIN s{len(steps)} s ON s.word = sw.word)"])


WORDS = """
stops AS (SELECT ['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'with'] AS s),
dt AS (SELECT doc_id AS id, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') IF x <> '']) AS term FROM documents),
dw AS MATERIALIZED (SELECT id, term FROM dt, stops WHERE NOT list_contains(s, term))"""
TOKENS = f"""{WORDS},
q0 AS (SELECT item_id AS query, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') IF x <> '' AND NOT list_contains(s, x)]) AS term FROM benchmark, stops),
allw AS (SELECT term FROM dw UNION ALL SELECT term FROM q0), {_stems("allw")},
tf AS MATERIALIZED (SELECT id, stem AS term, count(*) AS tf FROM dw JOIN stem ON word = term GROUP BY ALL),
q AS MATERIALIZED (SELECT DISTINCT query, stem AS term FROM q0 JOIN stem ON word = term),
hits AS MATERIALIZED (
  SELECT h.query, h.id, round(h.rank, 9) AS rank FROM (SELECT query, id, count(DISTINCT q.term) AS met, sum(0.4 * ln(1 + tf)) AS rank FROM q JOIN tf ON tf.term = q.term GROUP BY ALL) h
  JOIN (SELECT query, count(*) AS needed FROM q GROUP BY 1) n ON n.query = h.query AND n.needed = h.met
)"""

TRIGRAMS = """
t AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_partkey AS title, 1970 + p_size AS year FROM part),
tg AS (SELECT id, year, unnest([x FOR x IN regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+') IF x <> '']) AS w FROM t),
grams AS MATERIALIZED (SELECT DISTINCT id, year, unnest([substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)]) AS g FROM tg),
qg AS (SELECT id AS query, year + id % 3 AS year, unnest([x FOR x IN regexp_split_to_array(lower(translate(title, 'a', 'o')), '[^\\p{L}\\p{N}]+') IF x <> '']) AS w FROM t),
qgrams AS MATERIALIZED (SELECT DISTINCT query, year, unnest([substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)]) AS g FROM qg),
n1 AS (SELECT query, count(*) AS n FROM qgrams GROUP BY 1),
n2 AS (SELECT id, count(*) AS m FROM grams GROUP BY 1),
sim AS MATERIALIZED (
  SELECT c.query, c.id, c.qy, c.ty, k / (n + m - k) AS s FROM (SELECT query, id, a.year AS qy, b.year AS ty, count(*) AS k FROM qgrams a JOIN grams b ON a.g = b.g GROUP BY ALL) c JOIN n1 ON n1.query = c.query JOIN n2 ON n2.id = c.id
)"""


def _best(threshold: float, where: str = "true") -> str:
    return f"""WITH {TRIGRAMS}
SELECT query, id, round(s, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS i FROM sim WHERE s >= {threshold} AND {where}) WHERE i = 1"""


OBSERVATIONS = """
obs AS MATERIALIZED (
  SELECT 'event_type' AS dimension, event_type AS category FROM events WHERE event_type IS NOT NULL
  UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL
  UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM events WHERE ts IS NOT NULL
  UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
),
counts AS (SELECT dimension, category, count(*) AS n FROM obs GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY dimension) AS share FROM counts)"""

TIED = """
pos AS (SELECT p_partkey, p_retailprice, p_size * 0.01 AS se, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part),
apart AS (SELECT *, CASE WHEN abs(p_retailprice - lag(p_retailprice) OVER o) > (se + lag(se) OVER o) / 2 THEN 1 ELSE 0 END AS new FROM pos WINDOW o AS (ORDER BY position)),
tied AS (SELECT p_partkey, position, CAST(sum(new) OVER (ORDER BY position) AS BIGINT) AS tie_group FROM apart)"""

REPLICATES = f"""{EDGES}, {P}, {SEEDS},
rs AS MATERIALIZED (SELECT r.replicate, t.work_id AS node, t.weight FROM trust t, (SELECT unnest(range(0, 7)) AS replicate) r WHERE t.pos <> r.replicate),
{signed("rp", "rs", ("replicate",))}"""


def _bands(scores: str, n_units: int, n_replicates: int, table: str = "works") -> str:
    return f"""
fullr AS (SELECT node, score FROM {scores} JOIN {table} ON id = node WHERE replicate = 0 AND {SHOWN}),
band AS (
  SELECT f.node, f.score, stddev_pop(coalesce(o.score, 0)) * sqrt({n_units - 1}) AS se
  FROM fullr f, (SELECT unnest(range(1, {n_replicates + 1})) AS replicate) r LEFT JOIN {scores} o ON o.node = f.node AND o.replicate = r.replicate GROUP BY ALL
)"""


def _jackknife(scores: str, n_units: int, n_replicates: int) -> str:
    return f"""{_bands(scores, n_units, n_replicates)}
SELECT node, round(score, 9) AS score, round(se, 9) AS stderr, round(greatest(0, score - 1.96 * se), 9) AS ci_low, round(score + 1.96 * se, 9) AS ci_high FROM band"""


PROFILE = f"""{EDGES}, {SEEDS}, {VIEWS}, {UNITS},
un AS (SELECT unit, row_number() OVER (ORDER BY unit) AS replicate FROM (SELECT DISTINCT unit FROM units)),
pr AS MATERIALIZED (
  SELECT 0 AS replicate, work_id AS node, weight FROM trust
  UNION ALL SELECT un.replicate, t.work_id, t.weight FROM trust t JOIN units u ON u.work_id = t.work_id JOIN un ON un.unit <> u.unit
),
ps AS MATERIALIZED (SELECT view, replicate, node, weight FROM pr, (SELECT DISTINCT view FROM vp)),
{signed("pv", "ps", ("view", "replicate"), ("view",), "vp", "vd")},
{compose("pc", "pv", {"author": 1.0, "topic": 1.0, "venue": 1.0, "institution": 1.0}, ("replicate",))},"""


def _levels(depth: int, cap: int | None, seeds: str) -> str:
    first = "" if cap is None else f" ORDER BY w DESC, 1 LIMIT {cap}"
    out = [f"l0 AS MATERIALIZED (SELECT DISTINCT node, 0 AS distance FROM {seeds})"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        out.append(
            f"l{k} AS MATERIALIZED (SELECT node, {k} AS distance FROM (SELECT dst AS node, max(weight) AS w FROM re JOIN l{k - 1} ON src = node GROUP BY 1{first}) WHERE node NOT IN ({seen}))"
        )
    return ",\n".join(out)


def _all_levels(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT node, distance FROM l{k}" for k in range(depth + 1))


ROUNDED = "re AS MATERIALIZED (SELECT src, dst, round(weight, 9) AS weight, context, relation FROM edges)"


def _paths(depth: int = 3, most: int = 8) -> str:
    target = "(SELECT id FROM works WHERE NOT is_stub AND id LIKE 'P%' ORDER BY in_corpus_cited_by, id LIMIT 1)"
    out = [f"b0 AS MATERIALIZED (SELECT {target} AS node, CAST(1.0 AS DOUBLE) AS product, {target} AS path)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM b{i}" for i in range(k))
        before = " + ".join(f"(SELECT count(*) FROM s{i} WHERE src IN (SELECT work_id FROM trust))" for i in range(1, k)) or "0"
        out.append(f"s{k} AS MATERIALIZED (SELECT src, product * weight AS product, src || ' > ' || path AS path, relation FROM re JOIN b{k - 1} ON dst = node WHERE src NOT IN ({seen}) AND ({before}) < {4 * most})")
        out.append(f"b{k} AS MATERIALIZED (SELECT src AS node, product, path FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY product DESC, path) AS i FROM s{k}) WHERE i = 1)")
    found = " UNION ALL ".join(f"SELECT * FROM s{k} WHERE src IN (SELECT work_id FROM trust)" for k in range(1, depth + 1))
    out.append(f"topp AS (SELECT * FROM ({found}) ORDER BY product DESC, path, relation LIMIT {most})")
    return ",\n".join(out)


def _pagerank(rounds: int) -> str:
    out = ["r0 AS MATERIALIZED (SELECT node, mass FROM seeds)"]
    for k in range(1, rounds + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT p.dst AS node, sum(mass * p) AS moved FROM r{k - 1} r JOIN p ON p.src = r.node GROUP BY 1)")
        out.append(
            f"r{k} AS MATERIALIZED (SELECT coalesce(m.node, s.node) AS node, 0.85 * coalesce(moved, 0) + (1 - 0.85 * (SELECT coalesce(sum(moved), 0) FROM m{k})) * coalesce(s.mass, 0) AS mass FROM m{k} m FULL JOIN seeds s ON s.node = m.node)"
        )
    return ",\n".join(out)


def _draw(walk: str, ego: str, step: int, which: int) -> str:
    x = f"({ego} * 1000003 + {walk} * 7919 + {(2 * step + which) * 104729} + 12345) % 2147483647"
    for shift, factor in ((15, 48271), (13, 69621), (16, 39373)):
        x = f"list_transform([{x}], lambda x: xor(x, x >> {shift}) * {factor} % 2147483647)[1]"
    return f"(list_transform([{x}], lambda x: xor(x, x >> 14))[1] / 2147483648.0)"


def _walks(n: int, steps: int) -> str:
    """CTEs that end in met (ego, walk, node, first, last); seeds are (ego, node, weight) in wseeds."""
    out = [
        "ways AS MATERIALIZED (SELECT src, dst, sum(p) OVER w AS hi, coalesce(sum(p) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(p) OVER (PARTITION BY src) AS total FROM p WINDOW w AS (PARTITION BY src ORDER BY dst))",
        "st AS (SELECT ego, node, sum(weight) OVER (PARTITION BY ego ORDER BY node) AS hi, sum(weight) OVER (PARTITION BY ego) AS total FROM wseeds WHERE weight > 0)",
        "sts AS MATERIALIZED (SELECT *, coalesce(lag(hi) OVER (PARTITION BY ego ORDER BY node), 0) AS lo FROM st)",
        f"wk AS MATERIALIZED (SELECT CAST(ego AS BIGINT) AS ego, walk FROM (SELECT DISTINCT ego FROM sts), (SELECT unnest(range(0, {n})) AS walk))",
        f"wu0 AS MATERIALIZED (SELECT ego, walk, floor(ln(1.0 - {_draw('walk', 'ego', 0, 0)}) / ln(0.85)) AS length, {_draw('walk', 'ego', 0, 1)} AS u FROM wk)",
        "wk0 AS MATERIALIZED (SELECT w.ego, w.walk, w.length, sts.node FROM wu0 w JOIN sts ON sts.ego = w.ego AND u * total >= lo AND u * total < hi)",
    ]
    for k in range(1, steps + 1):
        out.append(f"wu{k} AS MATERIALIZED (SELECT ego, walk, length, node, {_draw('walk', 'ego', k, 1)} AS u FROM wk{k - 1} WHERE length >= {k})")
        out.append(f"wk{k} AS MATERIALIZED (SELECT ego, walk, length, dst AS node FROM wu{k} JOIN ways ON src = node AND u * total >= lo AND u * total < hi)")
    union = " UNION ALL ".join(f"SELECT ego, walk, node, {k} AS step FROM wk{k}" for k in range(steps + 1))
    out.append(f"met AS MATERIALIZED (SELECT ego, walk, node, min(step) AS first, max(step) AS last FROM ({union}) GROUP BY ALL)")
    return ",\n".join(out)


def _fold_steps(steps: int) -> str:
    out = ["ev0 AS MATERIALIZED (SELECT * FROM eseeds)"]
    for i in range(1, steps + 1):
        x = f"ev{i - 1} x"
        out.append(f"""ev{i} AS MATERIALIZED (SELECT paper, node, sum(m) AS mass FROM (
  SELECT x.paper, p.dst AS node, x.mass * p.p AS m FROM {x} JOIN p ON p.src = x.node WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.paper = x.paper AND g.src = x.node)
  UNION ALL SELECT x.paper, o.dst, x.mass * o.p FROM {x} JOIN own o ON o.paper = x.paper AND o.src = x.node) GROUP BY ALL)""")
    union = " UNION ALL ".join(f"SELECT paper, node, mass * pow(0.85, {i}) AS score FROM ev{i}" for i in range(steps + 1))
    return ",\n".join([*out, f"ev AS MATERIALIZED (SELECT paper, node, sum(score) AS score FROM ({union}) GROUP BY ALL)"])


FOLDS = f"""{EDGES}, {P},
fullw AS (SELECT id FROM works WHERE NOT is_stub),
sets AS (SELECT src_id AS paper, dst_id AS ref FROM cit WHERE dst_id IN (SELECT id FROM fullw) AND src_id IN (SELECT id FROM fullw)),
okp AS (SELECT paper FROM sets GROUP BY 1 HAVING count(*) BETWEEN 18 AND 60 ORDER BY substr(md5('set|' || paper), 1, 8), paper LIMIT 200),
folds AS MATERIALIZED (
  SELECT paper, ref, row_number() OVER (PARTITION BY paper ORDER BY substr(md5(paper || '|' || ref), 1, 8), ref) <= greatest(2, floor(count(*) OVER (PARTITION BY paper) / 5)) AS held
  FROM sets WHERE paper IN (SELECT paper FROM okp)
),
gone AS MATERIALIZED (SELECT a.paper, e.src, e.dst, e.context, e.relation FROM edges e JOIN folds a ON a.ref = e.src JOIN folds b ON b.ref = e.dst AND b.paper = a.paper
  WHERE a.held <> b.held AND e.relation IN ('couples', 'co_cited')),
own AS MATERIALIZED (SELECT paper, src, dst, w / sum(w) OVER (PARTITION BY paper, src) AS p FROM (
  SELECT t.paper, e.src, e.dst, sum(e.weight) AS w FROM (SELECT DISTINCT paper, src FROM gone) t JOIN edges e ON e.src = t.src
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.paper = t.paper AND g.src = e.src AND g.dst = e.dst AND g.context = e.context AND g.relation = e.relation) GROUP BY 1, 2, 3)),
eseeds AS MATERIALIZED (SELECT paper, ref AS node, 1.0 / count(*) OVER (PARTITION BY paper) AS mass FROM folds WHERE NOT held),
{_fold_steps(5)},
pool AS (SELECT paper, node, round(score, 9) AS score FROM ev WHERE score > 0 AND node IN (SELECT id FROM fullw) AND NOT EXISTS (SELECT 1 FROM folds f WHERE f.paper = ev.paper AND f.ref = ev.node AND NOT f.held)),
top AS MATERIALIZED (SELECT paper, node FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, node) AS i FROM pool) WHERE i <= 25),
pct AS (SELECT id, (rank() OVER (ORDER BY in_corpus_cited_by) - 1) / count(*) OVER () AS pct FROM works WHERE NOT is_stub),
pop AS (SELECT paper, quantile_cont(pct, 0.5) AS popularity FROM top JOIN pct ON id = node GROUP BY 1),
near AS (SELECT DISTINCT f.paper, e.dst AS ref FROM folds f JOIN edges e ON e.src = f.ref WHERE NOT f.held AND e.context = 'citation'),
hit AS (SELECT f.paper, count(*) AS n_held, count(t.node) AS n_found, count(*) FILTER (n.ref IS NULL) AS n_far, count(t.node) FILTER (n.ref IS NULL) AS n_far_found
  FROM folds f LEFT JOIN top t ON t.paper = f.paper AND t.node = f.ref LEFT JOIN near n ON n.paper = f.paper AND n.ref = f.ref WHERE f.held GROUP BY 1)
SELECT hit.paper, n_held, n_found, round(n_found / n_held, 9) AS recall, n_far, n_far_found, round(popularity, 9) AS popularity FROM hit LEFT JOIN pop ON pop.paper = hit.paper"""

RING = f"""{EDGES},
rid AS (SELECT 'Cring' || i AS node FROM (SELECT unnest(range(0, 20)) AS i)),
ring_edges AS (SELECT src, dst, weight FROM edges UNION ALL SELECT a.node, b.node, 1.0 FROM rid a JOIN rid b ON a.node <> b.node
  UNION ALL SELECT work_id, 'Cring0', 1.0 FROM trust WHERE pos = 1 UNION ALL SELECT 'Cring0', work_id, 1.0 FROM trust WHERE pos = 1),
w2 AS (SELECT src, dst, sum(weight) AS w FROM ring_edges GROUP BY 1, 2), p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w2),
rseeds AS MATERIALIZED (SELECT work_id AS node, 1.0 / 6 AS mass FROM trust)"""


def _share(scores: str, digits: int = 9) -> str:
    return f"SELECT count(*) FILTER (node LIKE 'Cring%') AS n_ring, round(sum(CASE WHEN node LIKE 'Cring%' THEN greatest(score, 0) ELSE 0 END) / sum(greatest(score, 0)), {digits}) AS share FROM {scores}"


ORACLES = {
    "degree_stats": f"WITH {CORPUS} " + " UNION ALL ".join([_stats("author", "authors", "deg"), _stats("topic", "topics", "deg"), _stats("venue", "venues", "deg"), _stats("institution", "institutions", "deg"), _stats("references", "works", "ref_count", "ref_count > 0"), _stats("citers", "works", "in_corpus_cited_by", "in_corpus_cited_by > 0")]),
    "corpus_gate": f"""WITH {CORPUS}, g AS (SELECT count(*) AS n_works, count(*) FILTER (is_stub) AS n_stubs, count(*) FILTER (NOT is_stub) AS n_full,
 count(*) FILTER (ref_count = 0 AND in_corpus_cited_by = 0) AS n_orphans, count(*) FILTER (NOT is_stub AND (ref_count > 0 OR in_corpus_cited_by > 0)) AS n_linked FROM works)
SELECT *, (SELECT count(*) FROM cit) AS n_citations, round(n_linked / greatest(n_full, 1), 9) AS linked_share, n_full >= 2500 AND n_linked / greatest(n_full, 1) >= 0.9 AS passes FROM g""",
    "topic_idf": f"WITH {CORPUS} SELECT e AS topic_id, deg AS corpus_degree, round(idf, 9) AS idf FROM topics",
    "snowball": f"""WITH {CORPUS} SELECT dst_id AS id, count(DISTINCT src_id) AS referrers, CASE WHEN count(DISTINCT src_id) >= 3 THEN 'promote' ELSE 'stub' END AS decision
FROM cit WHERE dst_id NOT IN (SELECT id FROM base WHERE id LIKE 'C%' OR year < 1990) GROUP BY 1""",
    "briefs": f"""WITH {CORPUS} SELECT id AS node, title, year, substr(venue_id, 2) AS venue, coalesce(a.names, '') AS authors FROM base
LEFT JOIN (SELECT work_id, string_agg(s_name, ', ' ORDER BY position) AS names FROM wa JOIN supplier ON 'A' || s_suppkey = e GROUP BY 1) a ON work_id = id""",
    "edges_citation": f"WITH {CORPUS}, {AGED} SELECT src, dst, round(weight, 9) AS weight, context, relation FROM cites",
    "edges_entity": f"WITH {EDGES} SELECT src, dst, round(weight, 9) AS weight, context, relation FROM edges WHERE context <> 'citation'",
    "coupling_topk": f"WITH {COUPLING} {_neighbours('cp', 'couples')}",
    "cocitation_topk": f"WITH {CORPUS}, {COCITED} {_neighbours('cc', 'co_cited')}",
    "edges_dedup": f"""WITH {CORPUS}, {AGED}, {NEAREST},
fam AS (SELECT * FROM cites UNION ALL SELECT * FROM similar_edges),
best AS (SELECT src, dst, context, max(weight) AS weight, arg_max(relation, (weight, -place)) AS relation FROM fam GROUP BY 1, 2, 3)
SELECT context, relation, count(*) AS n, round(sum(weight), 6) AS total FROM best GROUP BY 1, 2""",
    "node_kinds": f"""WITH {EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT CASE substr(node, 1, 1) WHEN 'A' THEN 'author' WHEN 'T' THEN 'topic' WHEN 'V' THEN 'venue' WHEN 'I' THEN 'institution' ELSE 'paper' END AS kind, count(*) AS n FROM nodes GROUP BY 1""",
    "transition": f"WITH {EDGES}, {P} SELECT src, dst, round(p, 9) AS p FROM p",
    "return_diagonal": f"WITH {EDGES}, {P} SELECT node, round(back, 9) AS back FROM d",
    "propagate_seeds": f"WITH {EDGES}, {P}, {SEEDS}, {diffuse('x', 'seeds', absorb=True)} SELECT node, round(score, 9) AS score FROM x",
    "propagate_signed": f"""WITH {EDGES}, {P}, ss AS MATERIALIZED (SELECT work_id AS node, CASE WHEN pos = 6 THEN -1.0 ELSE weight END AS weight FROM trust), {signed("sg", "ss")}
SELECT * FROM (SELECT node, round(score, 9) AS score FROM sg) WHERE score <> 0""",
    "background": f"""WITH {EDGES}, {P}, nodes AS (SELECT src AS node FROM p UNION SELECT dst FROM p), ns AS (SELECT node FROM nodes JOIN works ON id = node WHERE NOT is_stub),
bs AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM ns) AS mass FROM ns), {diffuse("x", "bs")} SELECT node, round(score, 12) AS score FROM x JOIN works ON id = node WHERE score > 0""",
    "compose_mean": f"""WITH {CONTEXTS}, {compose("c", "cs", {"author": 2.0, "citation": 1.0, "topic": 1.0, "venue": 1.0, "institution": 1.0})}
SELECT * FROM (SELECT node, round(score, 9) AS score FROM c) WHERE score <> 0""",
    "context_breakdown": f"""WITH {CONTEXTS}, papers AS (SELECT cs.* FROM cs JOIN works ON id = node WHERE NOT is_stub),
grid AS (SELECT n.node, v.context FROM (SELECT DISTINCT node FROM papers) n, (SELECT unnest(['citation', 'author', 'topic', 'venue', 'institution']) AS context) v),
f AS (SELECT g.node, g.context, coalesce(s.score, 0) AS score, coalesce(b.score, 0) AS base FROM grid g LEFT JOIN papers s ON s.node = g.node AND s.view = g.context LEFT JOIN papers b ON b.node = g.node AND b.view = 'citation'),
m AS (SELECT node, context, score, CASE WHEN context = 'citation' THEN score ELSE score - base END AS marginal FROM f),
t AS (SELECT *, sum(abs(marginal)) OVER (PARTITION BY node) AS total FROM m)
SELECT node, context, round(score, 7) AS score, CASE WHEN round(marginal, 7) = 0 THEN 0.0 ELSE round(marginal, 7) END AS marginal, round(CASE WHEN total > 0 THEN abs(marginal) / total ELSE 0 END, 7) AS share FROM t""",
    "ppr_fixed_iter": f"WITH {EDGES}, {P}, {SEEDS}, {_pagerank(40)} SELECT * FROM (SELECT node, round(mass, 9) AS score FROM r40) WHERE score > 0",
    "ring_share": f"""WITH {RING}, {diffuse("x", "rseeds")} SELECT * FROM ({_share("x")})""",
    "ring_comparison": f"""WITH {RING}, {D}, sseeds AS (SELECT node, mass AS weight FROM rseeds), {signed("rs", "sseeds")}, seeds AS (SELECT node, mass FROM rseeds), {_pagerank(130)}
SELECT a.n_ring, round(a.share, 7) AS signed_share, round(b.share, 7) AS pagerank_share, round(a.share / b.share, 7) AS ratio
FROM ({_share("rs", 18)}) a, ({_share("(SELECT node, mass AS score FROM r130)", 18)}) b""",
    "walk_scores": f"""WITH {EDGES}, {P},
wseeds AS MATERIALIZED (
  SELECT 1 AS ego, work_id AS node, weight FROM trust
  UNION ALL SELECT 2, work_id, CASE WHEN pos = 6 THEN -1.0 ELSE weight END FROM trust WHERE pos <= 3 OR pos = 6
  UNION ALL SELECT 3, work_id, CASE WHEN pos = 1 THEN -1.0 ELSE weight END FROM trust WHERE pos >= 4 OR pos = 1
), {_walks(10_000, 80)},
bad AS (SELECT m.ego, m.walk, m.last AS until, abs(s.weight) AS w FROM met m JOIN wseeds s ON s.ego = m.ego AND s.node = m.node WHERE s.weight < 0),
lost AS (SELECT m.ego, m.node, sum(w) AS penalty FROM met m JOIN bad b ON b.ego = m.ego AND b.walk = m.walk AND m.first <= b.until GROUP BY ALL),
counted AS (SELECT ego, node, count(*) AS visits FROM met GROUP BY ALL)
SELECT CAST(c.ego AS INTEGER) AS ego, c.node, visits, coalesce(penalty, 0) AS penalty, round((visits - coalesce(penalty, 0)) / (sum(visits) OVER (PARTITION BY c.ego) + 10000), 9) AS score
FROM counted c LEFT JOIN lost l ON l.ego = c.ego AND l.node = c.node""",
    "rank_percentiles": f"WITH {CORPUS} SELECT id, in_corpus_cited_by, round(cume_dist() OVER (ORDER BY in_corpus_cited_by), 9) AS pct FROM works WHERE NOT is_stub",
    "citation_percentile": f"WITH {CORPUS} SELECT DISTINCT cited_by_count, round(cume_dist() OVER (ORDER BY cited_by_count), 9) AS percentile FROM works WHERE NOT is_stub",
    "popularity_pctile": f"WITH {CORPUS} SELECT id, round((rank() OVER (ORDER BY in_corpus_cited_by) - 1) / count(*) OVER (), 9) AS below FROM works WHERE NOT is_stub",
    "jackknife": f"WITH {REPLICATES}, {_jackknife('rp', 6, 6)}",
    "tie_groups": f"WITH {TIED} SELECT * FROM tied",
    "tie_runs": f"""WITH {TIED}, r AS (SELECT tie_group, count(*) AS size, min(position) AS first, max(position) AS last FROM tied GROUP BY 1)
SELECT row_number() OVER (ORDER BY first) AS run, tie_group, size, first, last, CASE WHEN size > 1 THEN '=' ELSE '' END || first AS label FROM r""",
    "lift_rank": f"""WITH {RANKING}, nodes AS (SELECT src AS node FROM p UNION SELECT dst FROM p), ns AS (SELECT node FROM nodes JOIN works ON id = node WHERE NOT is_stub),
bs AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM ns) AS mass FROM ns), {diffuse("bg", "bs")}
SELECT r.node, round(ln(r.score + 1e-9) - 0.5 * ln(coalesce(round(bg.score, 12), 0) + 1e-9), 6) AS lift FROM ranking r LEFT JOIN bg ON bg.node = r.node""",
    "trust_units": f"WITH {EDGES}, {UNITS} SELECT * FROM units",
    "rank_profile": f"""WITH {PROFILE} x AS (SELECT 1), {_bands("pc", 5, 5)},
told AS (SELECT node, s * 1.0 AS score, s * round(se / score, 8) AS stderr, s * round(greatest(0, score - 1.96 * se) / score, 8) AS ci_low, s * round((score + 1.96 * se) / score, 8) AS ci_high
  FROM (SELECT *, CAST(printf('%.8e', score) AS DOUBLE) AS s FROM band)),
pos AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, node) AS INTEGER) AS rank FROM told),
apart AS (SELECT *, CASE WHEN abs(score - lag(score) OVER o) > (stderr + lag(stderr) OVER o) / 2 THEN 1 ELSE 0 END AS new FROM pos WINDOW o AS (ORDER BY rank))
SELECT node, score, stderr, ci_low, ci_high, true AS reliable, rank, CAST(sum(new) OVER (ORDER BY rank) AS BIGINT) AS tie_group FROM apart""",
    "recommendations": f"""WITH {RANKING}, {MERIT}, re AS (SELECT * FROM edges), {_levels(4, None, "seeds")}, dist AS ({_all_levels(4)}),
pool AS (SELECT r.node, r.score, coalesce(m.score, 0) AS merit, coalesce(least(distance, 4) / 4, 1.0) AS novelty FROM ranking r LEFT JOIN merit m ON m.node = r.node LEFT JOIN dist ON dist.node = r.node),
pc AS (SELECT *, cume_dist() OVER (ORDER BY score) AS tp, cume_dist() OVER (ORDER BY merit) AS gp FROM pool),
b AS (SELECT node, round((1 - 0.4) * tp + 0.4 * gp * novelty, 9) AS blend, tp, gp, novelty FROM pc)
SELECT * FROM (SELECT row_number() OVER (ORDER BY blend DESC, node) AS rank, node, blend, round(tp, 9) AS trust_pct, round(gp, 9) AS global_pct, novelty FROM b) WHERE rank <= 25""",
    "blindspots": f"""WITH {RANKING}, {MERIT}, mp AS (SELECT node, cume_dist() OVER (ORDER BY score) AS tp FROM ranking), gp AS (SELECT node, cume_dist() OVER (ORDER BY score) AS gp FROM merit),
g AS (SELECT gp.node, round(gp - coalesce(tp, 0), 9) AS gap, gp, coalesce(tp, 0) AS tp FROM gp JOIN works ON id = gp.node LEFT JOIN mp ON mp.node = gp.node WHERE {SHOWN})
SELECT * FROM (SELECT row_number() OVER (ORDER BY gap DESC, node) AS rank, node, gap, round(gp, 9) AS global_pct, round(tp, 9) AS trust_pct FROM g WHERE gap > 0) WHERE rank <= 25""",
    "simulate_moves": f"""WITH {RANKING}, s5 AS MATERIALIZED (SELECT work_id AS node, weight FROM trust WHERE pos <= 5), {signed("s2", "s5")},
a AS (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) AS rank FROM ranking),
b AS (SELECT node, round(score, 12) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, node) AS rank FROM s2 JOIN works ON id = node WHERE {SHOWN}),
m AS (SELECT coalesce(a.node, b.node) AS node, coalesce(a.rank, past) AS rank_before, coalesce(b.rank, past) AS rank_after, round(coalesce(b.score, 0) - coalesce(a.score, 0), 9) AS delta_score
  FROM a FULL JOIN b ON a.node = b.node, (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + 1 AS past))
SELECT node, rank_before, rank_after, rank_before - rank_after AS delta_rank, delta_score FROM m WHERE rank_before <> rank_after OR delta_score <> 0 ORDER BY abs(rank_before - rank_after) DESC, abs(delta_score) DESC, node LIMIT 100""",
    "diversity_entropy": f"""WITH {OBSERVATIONS}, h AS (SELECT dimension, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_categories, -sum(share * ln(share)) AS entropy FROM shares GROUP BY 1),
w AS (SELECT *, CASE WHEN least(greatest(n_obs, 1), greatest(n_categories, 1)) > 1 THEN ln(least(greatest(n_obs, 1), greatest(n_categories, 1))) ELSE 0 END AS most FROM h)
SELECT dimension, n_obs, n_categories, round(entropy, 9) AS entropy, round(most, 9) AS most, round(CASE WHEN most > 0 THEN entropy / most ELSE 0 END, 9) AS normalised FROM w""",
    "concentration": f"""WITH {OBSERVATIONS}, r AS (SELECT dimension, category, n, round(share, 9) AS share, row_number() OVER (PARTITION BY dimension ORDER BY round(share, 9) DESC, category) AS place FROM shares)
SELECT dimension, category, n, share, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4 ORDER BY share DESC, dimension, category LIMIT 8""",
    "bfs_distance": f"WITH {EDGES}, {ROUNDED}, all_seeds AS (SELECT work_id AS node FROM trust), {_levels(4, 30000, 'all_seeds')} {_all_levels(4)}",
    "explain_paths": f"WITH {EDGES}, {ROUNDED}, {_paths()} SELECT path, src AS seed, relation, round(product, 12) AS weight, round(product / (SELECT sum(product) FROM topp), 9) AS contribution FROM topp",
    "subgraph": f"""WITH {EDGES}, {ROUNDED} SELECT src, dst, weight, context, relation FROM re
WHERE (src IN (SELECT work_id FROM trust) OR dst IN (SELECT work_id FROM trust)) AND substr(src, 1, 1) IN ('C', 'P', 'A', 'V') AND substr(dst, 1, 1) IN ('C', 'P', 'A', 'V')
ORDER BY weight DESC, src, dst, context, relation LIMIT 150""",
    "word_stems": f"WITH {WORDS}, {_stems('dw')} SELECT word, stem FROM stem",
    "text_rank": f"WITH {TOKENS} SELECT query, id, rank FROM hits",
    "rrf_fuse": f"""WITH {TOKENS}, r AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY rank DESC, id % 17 DESC, id) AS text_rank FROM hits) WHERE text_rank <= 500),
k AS (SELECT r.query, r.id, row_number() OVER (PARTITION BY r.query ORDER BY CAST(d.n_chars % 97 AS DOUBLE) DESC, r.id) AS mr FROM r JOIN documents d ON d.doc_id = r.id),
j AS (SELECT r.query, r.id, text_rank, coalesce(mr, count(mr) OVER (PARTITION BY r.query) + 1) AS merit_rank FROM r LEFT JOIN k ON k.query = r.query AND k.id = r.id),
f AS (SELECT *, 1.0 / (60 + text_rank) + 1.0 / (60 + merit_rank) AS rrf FROM j)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, merit_rank, text_rank, id) AS position, id, round(rrf, 12) AS rrf, text_rank, merit_rank FROM f""",
    "trigram_match": _best(0.3),
    "title_match_year": _best(0.55, "abs(qy - ty) <= 1"),
    "doi_normalise": """SELECT p_partkey, '10.1' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '/abc.' || p_partkey AS doi, '2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS arxiv, 2005 AS year, '2000s' AS decade FROM part""",
    "eval_recall": f"WITH {FOLDS}",
    "kendall": f"""WITH {CORPUS}, v AS (SELECT id, in_corpus_cited_by AS a, cited_by_count AS b FROM works WHERE NOT is_stub),
pairs AS (SELECT sign(x.a - y.a) AS s, sign(x.b - y.b) AS t FROM v x JOIN v y ON x.id < y.id)
SELECT (SELECT count(*) FROM v) AS n, CAST(count(*) FILTER (s * t < 0) AS BIGINT) AS discordant, round(sum(s * t) / sqrt(CAST(sum(abs(s)) AS DOUBLE) * sum(abs(t))), 9) AS tau FROM pairs""",
    "spearman": f"""WITH {CORPUS}, v AS (SELECT in_corpus_cited_by AS a, cited_by_count AS b FROM works WHERE NOT is_stub),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r""",
    "page_furniture": r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT source, trim(t) AS t, doc_id || ':' || CAST(floor(i / 12) AS BIGINT) AS page FROM l)
SELECT source AS doc, t AS text, count(DISTINCT page) AS pages FROM s WHERE t <> '' AND length(t) < 60 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""",
}
