"""Views, look-ups and words on small frames, with the cases that the tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import display
from quillgraph.operators import graph, lookup, rank, traverse
from quillgraph.sources import testdata

EDGE = "src string, dst string, weight double, context string, relation string"


def test_view_with_distrust_focus_and_hidden(spark):
    edges = spark.createDataFrame([("P1", "P2", 0.9, "citation", "cites"), ("P2", "A1", 0.6, "author", "authored_by"), ("P3", "P4", 0.5, "citation", "cites"), ("P8", "P9", 1.0, "citation", "cites")], EDGE)
    trust = spark.createDataFrame([("P1", 4, False), ("P3", 2, True)], "work_id string, strength int, is_distrust boolean")
    ranking = spark.createDataFrame([("P2", 1, 0.4), ("P4", 2, 0.1)], "node string, rank int, score double")
    works = spark.createDataFrame([("P1", "one", 2000), ("P2", None, None)], "id string, title string, year int")
    names = spark.createDataFrame([("A1", "Ann")], "id string, display_name string")
    nodes, drawn = traverse.profile_view(edges, trust, ranking, works, names)
    assert {(r.node, r.kind, r.label, r.trust) for r in nodes.collect()} == {("U1", "profile", "Your trust profile", 0.0), ("P1", "paper", "one", 0.0), ("P2", "paper", "P2", 0.4), ("P3", "paper", "P3", 0.0), ("P4", "paper", "P4", 0.1), ("A1", "author", "Ann", 0.0)}
    assert {(r.src, r.dst, r.weight, r.relation) for r in drawn.collect() if r.src == "U1"} == {("U1", "P1", 1.0, "trusts"), ("U1", "P3", -1.0, "distrusts")}
    nodes, drawn = traverse.profile_view(edges, trust, ranking, works, names, focus="P9", hidden=spark.createDataFrame([("P4",)], "work_id string"))
    assert "P4" not in {r.node for r in nodes.collect()}
    assert {(r.src, r.dst) for r in drawn.collect()} == {("P1", "P2"), ("P2", "A1"), ("P8", "P9"), ("U1", "P1"), ("U1", "P3")}


def test_lift_bands_may_go_below_zero(spark):
    scores = spark.createDataFrame([(0, "P1", 0.1), (0, "P2", 0.2), (1, "P1", 0.05), (2, "P1", 0.1), (2, "P2", 0.1)], "replicate int, node string, score double")
    back = spark.createDataFrame([("P1", 0.01)], "node string, score double")
    shown = spark.createDataFrame([("P1",), ("P2",)], "node string")
    lift = lambda s, b: math.log(s + 1e-9) - 0.5 * math.log(b + 1e-9)
    first, second = rank.lift_profile(scores, back, shown, 2, 2).orderBy("rank").collect()
    assert (first.node, second.node) == ("P2", "P1")
    assert first.lift == pytest.approx(lift(0.2, 0), abs=1e-6) and first.stderr == pytest.approx(lift(0.1, 0) / 2, abs=1e-6)  # 0 where not reached
    assert second.ci_low == pytest.approx(second.lift - 1.96 * abs(lift(0.1, 0.01) - lift(0.05, 0.01)) / 2, abs=1e-5) and second.ci_low < 0


def test_words(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("x")).first().x
    assert text(display.score_text(F.lit(0.0143271), F.lit(0.004))) == "0.014"
    assert text(display.score_text(F.lit(0.0001), F.lit(0.04))) == "<0.01"
    assert text(display.score_text(F.lit(1234.5678), F.lit(None).cast("double"))) == "1234.5678"
    assert [text(display.percentile_text(F.lit(p))) for p in (0.996, 1.0, 42.0, 0.111)] == ["99th", "100th", "42nd", "11th"]
    assert text(display.people_text(F.array(*[F.lit(x) for x in "abcde"]))) == "a, b, c and 2 more"
    flat = display.bars(spark.createDataFrame([(2.0, 2.0, 2.0)], "score double, ci_low double, ci_high double")).first()
    assert (flat.bar_center, flat.bar_low, flat.bar_high, flat.shade) == (0.5, 0.5, 0.51, 1.0)


def test_lookups(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "x", "r"), ("a", "c", 0.001, "x", "r"), ("a", "d", -0.5, "x", "r"), ("a", "a", 0.3, "x", "r")], EDGE)
    assert sorted(r.dst for r in lookup.pruned(edges).collect()) == ["a", "b", "d"]
    assert lookup.accepted(edges).count() == 0
    around = lookup.neighbours(edges, spark.createDataFrame([("a",)], "node string"), "all", gt=0.001)
    assert [(r.place, r.other) for r in around.orderBy("place").collect()] == [(1, "b"), (2, "a")]
    rows = spark.createDataFrame([(1, None), (2, 1999), (3, 2005)], "rank int, year int")
    assert [r.rank for r in lookup.arranged(rows, "year", True).orderBy("place").collect()] == [3, 2, 1]
    assert [r.rank for r in lookup.arranged(rows, "year", False).orderBy("place").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        lookup.arranged(rows, "colour", True)
    works = spark.createDataFrame([("1", "user_upload"), ("2", "other")], "id string, source string")
    assert [r.id for r in lookup.shown(works, spark.createDataFrame([("1", 7)], "work_id string, profile_id int"), None).collect()] == ["2"]
    raw = spark.createDataFrame([('{"l": [1, 2]}',), ('{"l": 3}',), ("no json",), (None,)], "raw string")
    assert [r.n for r in raw.select(lookup.n_listed(F.col("raw"), "l").alias("n")).collect()] == [2, 0, 0, 0]


def test_mutual_ways_take_parallel_edges_and_meet_once(spark):
    rows = [("P1", "P2", 0.3, "a", "x"), ("P1", "P2", 0.9, "b", "x"), ("P2", "P1", 0.4, "a", "x"), ("P3", "P1", 0.5, "a", "x"), ("P4", "P4", 0.2, "a", "x"), ("P6", "P5", 0.7, "a", "x"), ("P5", "P6", 0.1, "b", "x")]
    edges = spark.createDataFrame(rows, EDGE)
    found = lookup.mutual_ways(edges)
    strongest = edges.groupBy(F.col("src").alias("ego"), F.col("dst").alias("node")).agg(F.max("weight").alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lookup.mutual(strongest).collect()))
    assert ("P4", "P4", 0.2, 0.2) in set(map(tuple, found.collect()))
    assert lookup.mutual_ways(edges)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_edges_around_nodes_are_those_of_the_whole_graph(spark):
    c = testdata.read(spark, "/root/testdata/sf0.001").stored()
    nodes = testdata.trust_set(c.works).select(F.col("work_id").alias("node"))
    ids = {r.node for r in nodes.collect()}
    want = {tuple(r) for r in graph.build(c).collect() if r.src in ids or r.dst in ids}
    assert {tuple(r) for r in graph.around(c, nodes).collect()} == want
