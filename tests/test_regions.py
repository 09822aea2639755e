"""Bibliography regions against plain loops, and the steps around them."""

import random
import re

from quillgraph.operators import biblio
from quillgraph.plans import layouts
from quillgraph.sources.files import LAYOUT


def frame(spark, docs):
    rows = [(d, i, t, 50.0, 10.0 * i, 250.0, 10.0 * i + 8, size, 1, None) for d, lines in docs.items() for i, (t, size) in enumerate(lines, 1)]
    return spark.createDataFrame(rows, LAYOUT)


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc, []).append(r.pos)
    return {d: sorted(p) for d, p in out.items()}


def test_headings(spark):
    texts = ["7 References", "R E F E R E N C E S", "IV. Bibliografía:", "  Список  литературы ", "references to the past", "参考文献", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = [r.h for r in df.select("i", biblio.heading(df.text).alias("h")).orderBy("i").collect()]
    assert found == ["references", "references", "bibliografía", "список литературы", "references to the past", "参考文献", None]


def test_a_line_as_large_as_the_heading_ends_the_region(spark):
    ref = "Smith, J. A study of one thing. 1999."
    docs = {
        "display": [("Text", 10.0), ("References", 14.0), (ref, 10.0), (ref, 14.0), (ref, 10.0), ("Proofs of claims", 14.0), (ref, 10.0)],
        "small": [("References", 10.0), (ref, 10.0), ("a line of the same size", 10.0), (ref, 10.0), ("B. Appendix: more", 10.0), (ref, 10.0)],
        "twice": [("References", 10.0), ("in the table of contents", 10.0), ("Literaturverzeichnis", 10.0), (ref, 10.0), ("Annex", 10.0)],
        "last": [("Text", 10.0), ("References", 10.0)],
    }
    assert kept(biblio.headed_region(frame(spark, docs))) == {"display": [3, 4, 5], "small": [2, 3, 4], "twice": [4]}


def test_keyed_region(spark):
    key = [(f"[{k}] A. Author, a title", 10.0) for k in range(1, 10)]
    prose = [("some prose", 10.0)] * 5
    docs = {"dense": [*prose, ("[1] is cited first", 10.0), *[("prose", 10.0)] * 90, *prose, *key], "few": [*prose, *key[:7]], "late": [*prose, *key[1:]]}
    assert kept(biblio.keyed_region(frame(spark, docs))) == {"dense": list(range(102, 111))}


def runs(likely):
    """The densest run of a list of booleans, as 0-based positions, walking line by line."""
    best, start, last, n = (-1, None, None), None, None, len(likely)

    def close(first, stop, length):
        nonlocal best
        if length >= max(best[0], 0):
            best = (length, first, stop)

    for i, hit in enumerate(likely):
        if hit:
            start, last = i if start is None else start, i
        elif start is not None and i - last > 3:
            close(start, last, last - start)
            start = None
    if start is not None:
        close(start, n - 1, n - start)
    if best[1] is None:
        return []
    window = list(range(best[1], best[2] + 1))
    return window if len(window) >= 8 and sum(likely[i] for i in window) / len(window) >= 0.6 else []


def test_dense_region(spark):
    drawn, docs = random.Random(5), {}
    for d in range(40):
        share = drawn.choice([0.3, 0.6, 0.8])
        docs[f"d{d}"] = [("Smith, J. A study of one thing. 1999." if drawn.random() < share else "plain prose goes on", 10.0) for _ in range(drawn.randrange(1, 60))]
    docs["end"] = [("x", 10.0)] * 9 + [("Smith, J. One thing. 1999.", 10.0)] * 9 + [("x", 10.0)] * 3
    want = {d: [i + 1 for i in runs([bool(re.match("Smith", t)) for t, _ in lines])] for d, lines in docs.items()}
    found = kept(biblio.dense_region(frame(spark, docs)))
    assert found == {d: p for d, p in want.items() if p} and len(found) > 5 and found["end"] == list(range(10, 22))


def test_region_takes_the_first_way_that_finds_lines(spark):
    key = [(f"[{k}] A. Author, a title. 19{k:02}.", 10.0) for k in range(1, 10)]
    docs = {"a": [("References", 10.0), *key, ("Appendix", 10.0), *key], "b": [("x", 10.0)] * 5 + key, "c": [("x", 10.0)] * 5 + [("Smith, J. One thing. 1999.", 10.0)] * 9, "d": [("x", 10.0)] * 30, "e": []}
    assert kept(biblio.region(frame(spark, docs))) == {"a": list(range(2, 11)), "b": list(range(6, 15)), "c": list(range(6, 15))}


def test_extract_refuses_short_tails_and_reads_columns(spark):
    assert {r.doc for r in biblio.extract(layouts.frame(spark)).collect()} >= {"numeric", "indent"}
    assert biblio.extract(frame(spark, {"scan": [("References", 10.0), ("[1] A. Author, 1999.", 10.0)]})).count() == 0
    # two columns of five lines each, given by height: the left one is read first
    rows = [("two", 2 * i + side, f"{side}:{i}", 60.0 + 250 * side, 10.0 * i, 280.0 + 250 * side, 10.0 * i + 8, 10.0, 1, None) for i in range(6) for side in (0, 1)]
    found = biblio.reading_order(biblio.in_columns(spark.createDataFrame(rows, LAYOUT))).orderBy("pos").collect()
    assert [r.text for r in found] == [f"{side}:{i}" for side in (0, 1) for i in range(6)]
