"""The best title of each query in blocks, against every pair of a query and a title."""

import random

import pytest

from quillgraph.operators import nearest, search


def _grams(text):
    return {f"  {w} "[i : i + 3] for w in text.lower().split() for i in range(len(w) + 1)}


def _plain(queries, titles, threshold, years):
    out = {}
    for q, text, year in queries:
        found = []
        for i, title, other in titles:
            a, b = _grams(text), _grams(title)
            s = len(a & b) / len(a | b) if a | b else 0.0
            if s >= threshold and (not years or (year is not None and other is not None and abs(year - other) <= 1)):
                found.append((-s, i))
        if found:
            out[q] = (min(found)[1], round(-min(found)[0], 9))
    return out


def _words(draw):
    return " ".join(draw.choice(["steel", "bolt", "blue", "anvil", "rod", "Ring", "été"]) for _ in range(draw.randint(0, 3))) + f" {draw.randint(0, 4000)}"


@pytest.mark.parametrize("years", [False, True])
@pytest.mark.parametrize("threshold", [0.2, 0.55])
def test_against_every_pair(spark, years, threshold):
    draw = random.Random(5)
    titles = [(f"t{i}", _words(draw), draw.choice([None, 1990, 1991, 1994])) for i in range(400)] + [("t5x", "bolt", 1990)]
    queries = [(i, draw.choice([str.upper, lambda t: t.replace("o", "a"), lambda t: t + "9"])(draw.choice(titles)[1]), draw.choice([None, 1992, 1993])) for i in range(150)]
    queries += [(900, "nothing alike", 1990), (901, "", 1990), (902, None, 1990)]
    a = spark.createDataFrame(queries, "query long, text string, year int")
    b = spark.createDataFrame(titles, "id string, title string, year int")
    found = search.trigram_matches(a, b, threshold, years=years)
    expected = _plain([q for q in queries if q[1]], titles, threshold, years)
    assert {r.query: (r.id, r.similarity) for r in found.collect()} == expected and expected


def test_no_row_for_a_pair(spark, monkeypatch):
    """Every title shares most trigrams with every query: pairs stay in arrays, in small blocks as in large ones (F10, F11, F12)."""
    draw = random.Random(6)
    titles = [(i, f"steel bolt of kind {draw.randint(0, 10**6)}", None) for i in range(700)]
    queries = [(i, t.replace("ee", "ea"), None) for i, t, _ in titles[::5]]
    a, b = (spark.createDataFrame([r[:2] for r in rows], f"{key} long, {text} string") for rows, key, text in ((queries, "query", "text"), (titles, "id", "title")))
    expected = _plain(queries, titles, 0.3, False)
    blocks = nearest.best

    def small(*args):
        return blocks(*args, n_titles=100, n_queries=40, gathered=500, compared=50, table=2000)

    for best in (blocks, small):
        monkeypatch.setattr(nearest, "best", best)
        found = search.trigram_matches(a, b, 0.3)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        assert {r.query: (r.id, r.similarity) for r in found.collect()} == expected
