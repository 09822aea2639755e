"""Substring, suffix-array and n-gram dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import components, ngram_join, substring_dedup, suffix_dedup
from quillgraph.llm.chunks import Chunk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words_removed(rows, n):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    ids = [d if d is not None else 2**62 for d, *_ in rows]
    low: dict = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            low[k] = min(low.get(k, 2**63), d)
    out = []
    for (doc, *_), d, w in zip(rows, ids, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if low[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [13, 4])
def test_substring_dedup(docs, rows, n):
    assert as_rows(substring_dedup.remove_repeated(docs, n, chunk_bytes=3000)) == words_removed(rows, n)


def test_covers_meet_at_every_shift():
    for v, cover in substring_dedup.COVERS.items():
        assert all(any((i + k) % v in cover and (j + k) % v in cover for k in range(v)) for i in range(v) for j in range(v))


def repeated(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [np.array([seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)], dtype=bool) for t in texts]


def bytes_removed(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for (doc, text, *_), t, flags in zip(rows, texts, repeated(texts, length), strict=True):
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in np.flatnonzero(flags):
            gone[i] += 1
            gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), None if text is None else kept.decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup(docs, rows, length):
    assert as_rows(suffix_dedup.remove_repeated_bytes(docs, length, chunk_bytes=3000)) == bytes_removed(rows, length)


def test_suffix_arrays_and_prefixes():
    rng = random.Random(2)
    for _ in range(120):
        alphabet = rng.choice([b"ab", b"a\0b", bytes(range(97, 110))])
        text = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) * rng.randint(1, 3)
        data = np.frombuffer(text, dtype=np.uint8)
        sa = suffix_dedup.suffix_array(data)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for r, x in list(enumerate(suffix_dedup.common_prefixes(data, sa)))[1:]:
            a, b = text[sa[r - 1] :], text[sa[r] :]
            assert x == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_shards_find_what_one_array_finds():
    rng = random.Random(4)
    for _ in range(60):
        base = bytes(rng.choice(b"abc") for _ in range(200))
        texts = sorted({base[rng.randint(0, 30) :][: rng.randint(20, 150)] + bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(10)})
        for shard in (10**6, 150):
            found = suffix_dedup.repeated_windows(texts, np.zeros(len(texts), dtype=np.uint64), 12, shard)
            assert all((a == b).all() for a, b in zip(found, repeated(texts, 12), strict=True))


def test_blocks_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"abcdef ") for _ in range(5000)), dtype=np.uint8)
    chunk = Chunk(np.arange(2), np.zeros(2, bool), np.zeros(2, bool), np.array([0, 2600, 5000]), data)
    whole = suffix_dedup.Blocks(chunk, 100)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    cut = suffix_dedup.Blocks(chunk, 100)
    assert whole.first.tolist() == cut.first.tolist() and whole.last.tolist() == cut.last.tolist()
    assert whole.unique.tolist() == cut.unique.tolist() and whole.text_hash.tolist() == cut.text_hash.tolist()


def test_repeats_are_cut_and_columns_stay(docs, rows):
    out = suffix_dedup.without_repeats(docs, 60, chunk_bytes=3000)
    assert out.columns == docs.columns and out.count() == len(rows)
    digest = {(r[0], r[1]): r[2] for r in ((d, len((t or "").encode()), None) for d, t, *_ in rows)}
    kept = out.collect()
    assert sum(len((r.text or "").encode()) for r in kept) <= sum(n for _, n in digest)
    assert Counter(r.answer for r in kept) == Counter(r[5] for r in rows)


def joined(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").translate(LOW).encode().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)), key=str), len({find(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, n, percent):
    expected, groups = joined(rows, n, percent)
    assert as_rows(ngram_join.join_components(docs, n, percent, chunk_bytes=3000)) == expected
    if n == 5:
        kept = ngram_join.one_of_each(docs, n, percent, chunk_bytes=3000)
        assert kept.columns == docs.columns and kept.count() == groups


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 21), (None, 3)], "a long, b long")
    found = {r.node: r.label for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(1, 13), 1), 20: 20, 21: 20}


def test_empty_tables(nothing):
    assert substring_dedup.remove_repeated(nothing).collect() == []
    assert suffix_dedup.remove_repeated_bytes(nothing).collect() == []
    assert suffix_dedup.without_repeats(nothing).collect() == []
    assert ngram_join.join_components(nothing).collect() == []
    assert ngram_join.one_of_each(nothing).collect() == []
