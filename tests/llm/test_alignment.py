import hashlib
from collections import Counter

import pytest

from quillgraph.llm import alignment
from quillgraph.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
ODD = ["hi  there", "  a b", "\n\nx y", " ", "a\tb \n", "<s> x</s> <|endoftext|> <0x0A>", "é ﬁ　z", "one ▁ two", "\x00a\x1cb", "x;\r\ny \r z\r", "a" * 3000, "日本語 日本語", "don't we'll    q", "😀  p\u0085q", "a　\n b"]


@pytest.fixture(scope="module")
def pair():
    return alignment.pair(A, B)


def brute(pair, texts):
    """Per document from its whole text: every pair of tokens is looked at by its byte range."""
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        raw = (" " + text).encode()
        a = pair.a.encode(" " + text, add_special_tokens=False).ids
        b = pair.b.encode(text)
        ra, rb = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] or b"" for i in b]
        if b"".join(ra) != raw or b"".join(rb) != raw:
            continue
        spans = []
        for parts in (ra, rb):
            at, mine = 0, []
            for p in parts:
                mine.append((at, at + len(p)))
                at += len(p)
            spans.append(mine)
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        owner = [0] * (len(raw) + 1)
        for n, (s, e) in enumerate(spans[1]):
            owner[s:e] = [n] * (e - s)
        linked = [(i, j) for i, (s, e) in enumerate(spans[0]) for j in sorted(set(owner[s:e]))]
        groups, last = [], 0
        for end in sorted(both):
            groups.append(",".join(str(t) for t, (_, e) in zip(a, spans[0], strict=True) if last < e <= end) + "|" + ",".join(str(t) for t, (_, e) in zip(b, spans[1], strict=True) if last < e <= end))
            last = end
        pairs = [(a[i], b[j]) for i, j in linked]
        counts.update(set(pairs))
        found[-1] = (len(a), len(b), groups, pairs)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = x
            out.append((n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_cuts_are_safe(pair):
    for text in ODD:
        parts = pair.segments(text)
        assert "".join(parts) == " " + text
        assert [i for e in pair.a.encode_batch(parts, add_special_tokens=False) for i in e.ids] == pair.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for ids in pair.tokens_b(parts) for i in ids] == pair.b.encode(text)
    assert len(pair.segments("a b\nc\td")) == 4
    assert len(pair.segments("x;\r\ny")) == 1


def test_unproved_cuts_are_not_taken():
    white = alignment.Pair._cuts(["a", "▁b", "▁▁"])
    import re

    assert re.findall(white, " a b\nc") == [" a", " b", "\nc"]
    assert re.findall(alignment.Pair._cuts(["a▁b"]), " a b\nc") == [" a b", "\nc"]


def test_align_against_whole_texts(spark, docs, rows, nothing, pair):
    more = spark.createDataFrame([(1000 + i, t, "en", "s", len(t), None) for i, t in enumerate(ODD)], docs.schema)
    whole = docs.unionByName(more)
    got = sorted(tuple(r) for r in alignment.align(whole, A, B, chunk_bytes=4000).selectExpr("coalesce(doc_id, -1)", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    source = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    want = brute(pair, [t for _, t in source])
    assert got == sorted((-1 if i is None else i, *w) for (i, _), w in zip(source, want, strict=True))
    assert alignment.align(nothing, A, B).count() == 0
