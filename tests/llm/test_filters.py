"""Decontamination, URL filters, exact top-k and the mix against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from quillgraph.llm import decontaminate, mixing, topk, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(rows, items, n):
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        if i is not None and w:
            size = min(n, len(w))
            for k in range(len(w) - size + 1):
                grams[tuple(w[k : k + size])].add(i)
    out = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                ids = grams.get(tuple(w[k : k + size]))
                if ids:
                    hit.update(range(k, k + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items_of(rows):
    texts = sorted(t for _, t, *_ in rows if t and len(t) > 200)
    return [(1, " ".join(texts[0].split()[3:20])), (12, " ".join(texts[1].split()[2:6])), (2, texts[2].split()[0]), (3, texts[3]), (3, texts[4][:60]), (4, None), (5, "..."), (None, texts[5]), (6, " ".join(texts[0].split()[5:22]))]


@pytest.mark.parametrize("n", [13, 3])
def test_contamination(spark, docs, rows, n):
    items = items_of(rows)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), n)
    assert sorted((tuple(r) for r in found.collect()), key=str) == contaminated(rows, items, n)


def test_clean_keeps_rows_and_columns(spark, docs, rows, nothing):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in contaminated(rows, items, 13))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(rows)
    assert decontaminate.contamination(nothing, bench).collect() == []
    strict = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    one = spark.createDataFrame([(1, "x " * 70 + "Alpha, beta gamma! end")], "doc_id long, text string")
    assert decontaminate.clean(one, strict, strip=True).first().text == "x " * 70 + "! end"


def test_automaton_states_are_linear():
    words = [b"a", b"b"] * 40
    a = decontaminate.Automaton([(1, words), (2, words[1:]), (3, [b"c"])], 13)
    assert len(a.next) <= 2 * (len(words) * 2 + 1) + 1
    assert a.hits(words)[1] == {0, 1} and a.hits([b"c"]) == ([(0, 1)], {2})


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, action


@pytest.mark.parametrize("rate", [None, 0.5])
def test_url_verdicts(spark, rate):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2#f", "ftp://badexample.org/es/", "http://com/de/", "http://x.com/fr/a", "http://x.com/fr", "http:///es/", "a://b.org://c", "http://org", "http://org?/x", "http://x.com/de/\n"]
    rows = [(None if i % 7 == 6 else i, u, "<html>", "clash") for i, u in enumerate(urls * 3)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), RULES, rate=rate)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((i, *verdict(u)) for i, u, *_ in rows), key=str)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_cascade_is_exact_over_several_levels(spark):
    universe = [f"k{i}" for i in range(4000)]
    listed = universe[:300]
    built = url_filter.build(listed, spark.createDataFrame([(k,) for k in universe] + [(None,)], "key string"), rate=0.4)
    assert len(built.levels) > 2
    assert [k for k in universe if k in built] == listed
    assert "k1" not in url_filter.build([], spark.createDataFrame([("k1",)], "key string"))


def nearest(vectors, k, is_query):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if is_query(q):
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[i][1]) for i in range(60)] + [(500, None), (501, [0.1, None] * 6), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [0.0] * 12), (505, [0.1] * 3), (510, [0.2] * 3), (None, [0.1] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(4)
    found = topk.top_k(df, df.vec_id % 5 == 0)
    assert sorted(tuple(r) for r in found.collect()) == nearest(vectors, 5, lambda i: i % 5 == 0)
    assert topk.top_k(df.limit(0), df.vec_id % 5 == 0).collect() == []


def test_top_k_of_large_numbers_is_exact():
    ids, x = np.arange(4), np.array([[2**40, 1], [2**40, 2], [2**40, 3], [-(2**40), 0]], dtype=object)
    assert topk.Index(ids, x).search(9, np.array([2**40, 1], dtype=object), 2, []) == [(-(2**80 + 3), 2), (-(2**80 + 2), 1)]
    assert topk._exact(np.array([[2.0**40]])) is object and topk._exact(np.array([[2.0**20]])) is np.float64


def test_targets():
    assert mixing.word_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    capped = mixing.word_targets([1000, 10, 0, 100], [1, 2, 3, 1])
    assert capped[1] == 30 and capped[2] == 0 and sum(capped) == pytest.approx(1110) and capped[3] == 300
    assert mixing.word_targets([0, 0], [1, 2]) == [0, 0]


def test_permutations_and_counts():
    for size in (1, 2, 7, 64, 1000):
        for key in (1, -5):
            x = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(x.tolist()) == list(range(size))
    every = list(mixing.shard_counts(np.array([500, 3, 0, 97]), 64, 1))
    counts = np.array([c for _, _, c in every])
    assert counts.sum(axis=0).tolist() == [500, 3, 0, 97] and (counts[:-1].sum(axis=1) == 64).all()
    assert [s.tolist() for _, s, _ in every] == (np.cumsum(counts, axis=0) - counts).tolist()
    for low in range(10):  # a task finds its shards without the others
        alone = list(mixing.shard_counts(np.array([500, 3, 0, 97]), 64, 1, low, low + 2))
        assert [(k, s.tolist(), c.tolist()) for k, s, c in alone] == [(k, s.tolist(), c.tolist()) for k, s, c in every[low : low + 2]]


def test_mix_against_a_replay_of_its_slots(docs, rows):
    """What each document gives, from the words laid out in order, the slots and the blocks alone."""
    mix = mixing.Mix(docs, block_words=16, shard_slots=32, split_docs=5)
    placed, slots = mix.placed.collect(), mix.slots().collect()
    assert sorted(r.size for r in placed) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows)
    streams = defaultdict(dict)
    for k, r in enumerate(placed):
        for i in range(r.start, r.start + r.size):
            assert i not in streams[r.source_no]
            streams[r.source_no][i] = k
    for words in streams.values():  # no gaps: one stream of whole blocks but the last
        assert sorted(words) == list(range(len(words)))
    got = Counter()
    for s in slots:
        for i in range(s.block * 16, s.block * 16 + 16):
            if i in streams[s.source_no]:
                got[streams[s.source_no][i]] += 1
    by_source = Counter((s.source_no, s.block) for s in slots)
    for source, times in Counter(s.source_no for s in slots).items():  # each pass takes every block once
        blocks = -(-len(streams[source]) // 16)
        passes = [by_source[source, b] for b in range(blocks)]
        assert times == mix.quota[source] and max(passes) - min(passes) <= 1
    assert Counter(len(list(g)) for _, g in groupby(sorted(s.shard for s in slots))).most_common(1)[0][0] == 32
    expected = sorted((str(r.doc_id), str(r.source), r.size, got[k]) for k, r in enumerate(placed))
    assert expected == sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in mix.taken().collect())


def test_mix(spark, docs, rows, nothing):
    found = [tuple(r) for r in mixing.mix_sources(docs, block_words=16, shard_slots=32, split_docs=5).collect()]
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.word_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = Counter()
    for _, s, size, source_size, target, got in found:
        assert source_size == sizes[s] and target == pytest.approx(targets[s]) and 0 <= got <= 3 * size
        taken[s] += got
    assert len(found) == len(rows) and all(abs(taken[s] - targets[s]) <= 32 for s in order)
    again = [tuple(r) for r in mixing.mix_sources(docs.repartition(2), block_words=16, shard_slots=32, split_docs=5).collect()]
    assert sorted(found, key=str) == sorted(again, key=str)
    assert mixing.mix_sources(nothing).collect() == []
