"""Edges that are written by their source are not exchanged again, and no table is made twice."""

from __future__ import annotations

from quillgraph.operators import graph, score
from quillgraph.plans.lineage import dealt
from quillgraph.plans.queries import _Setting


def _edges(spark):
    rows = [(f"P{i % 7}", f"P{i % 5}", 1.0 + i % 3, "citation", ("cites", "couples")[i % 2]) for i in range(70)]
    return spark.createDataFrame(rows, "src string, dst string, weight double, context string, relation string")


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_transition_and_steps_read_buckets(spark):
    plain = graph.dedupe(_edges(spark))
    stored = dealt(graph.dedupe(_edges(spark), 3), "edges", ["src"], 3)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    assert _exchanges(score.transition(stored, dealt=True)) == 0
    p = score.stored_transition(stored, 3)
    x = spark.createDataFrame([("P1", 1.0)], "node string, mass double")
    assert _exchanges(x.hint("shuffle_hash").join(p.withColumnRenamed("src", "node"), "node")) == 1
    found, expected = (dict(map(tuple, score.diffuse(t, x, []).select("node", "score").collect())) for t in (p, score.transition(plain)))
    assert found.keys() == expected.keys()
    assert all(abs(found[n] - expected[n]) < 1e-12 for n in found)


def test_lists_of_a_query_share_their_tables(spark):
    s = _Setting(spark, "/root/testdata/sf0.001")
    assert s.transition() is s.transition()
    assert s.ranking() is s.ranking()
