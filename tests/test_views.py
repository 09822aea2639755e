"""All contexts at once, a column for each, give what rows by context give; a target alone gets its own scores."""

from __future__ import annotations

import numpy as np

from quillgraph.operators import rank, score, traverse, views
from quillgraph.plans.lineage import dealt
from quillgraph.plans.queries import _contexts, _Setting
from quillgraph.schema import EDGES, ENTITY_CONTEXTS


def _edges(spark, n=30, edges=220):
    rng = np.random.default_rng(11)
    rows = {(f"P{a}", f"P{b}", "citation"): float(w) for a, b, w in zip(rng.integers(n, size=edges), rng.integers(n, size=edges), rng.integers(1, 9, size=edges))}
    for i, c in enumerate(ENTITY_CONTEXTS):  # some pairs stand in the backbone too, and one entity has edges of its own view only
        rows |= {(f"P{a}", f"P{b}", c): 2.0 + i for a, b in rng.integers(n, size=(12, 2))}
        rows |= {(a, b, c): 0.5 for k in range(i, n, 5) for a, b in ((f"P{k}", f"E{i}"), (f"E{i}", f"P{k}"))}
    return spark.createDataFrame([(a, b, w, c, "cites") for (a, b, c), w in rows.items()], EDGES)


def _by_rows(spark, edges, seeds):
    p = score.transition(score.views(edges), ["view"], dealt=True).persist()
    everywhere = seeds.crossJoin(p.select("view").distinct())
    found = score.signed(p, everywhere, ["view"], ["view"], score.return_diagonal(p, ["view"])).select("view", "node", "score").collect()
    p = score.transition(edges).persist()
    found += score.signed(p, seeds, [], back=score.return_diagonal(p)).selectExpr("'all' AS view", "node", "score").collect()
    return {(r.view, r.node): r.score for r in found}


def test_columns_give_what_rows_give(spark):
    edges = _edges(spark)
    seeds = spark.createDataFrame([("P1", 1.0), ("P2", 0.45), ("P3", -1.0), ("nowhere", 0.2)], "node string, weight double")
    want = _by_rows(spark, edges, seeds)
    p = views.transition(edges, 3)
    assert p.count() == edges.select("src", "dst").distinct().count()
    got = {(r.view, r.node): r.score for r in views.signed(p, seeds, views.VIEWS).collect()}
    assert got.keys() == want.keys() and {v for v, _ in got} == set(views.VIEWS) and len(got) > 150
    assert all(abs(got[k] - want[k]) < 1e-14 for k in want)
    for target in ("P9", "P20", "E2", "P1", "nobody"):  # P1 is a seed
        alone = {(r.view, r.node): r.score for r in views.signed(p, seeds, views.VIEWS, target).collect()}
        assert alone.keys() == {k for k in want if k[1] == target}
        assert all(abs(alone[k] - want[k]) < 1e-14 for k in alone)


def test_contexts_hold_an_edge_once(spark, monkeypatch):
    # by rows, the paper edges were written five times
    s = _Setting(spark, "/root/testdata/sf0.001")
    written = []
    monkeypatch.setattr(views, "dealt", lambda df, *a: written.append(dealt(df, *a)) or written[-1])
    _contexts(s)
    assert [w.count() for w in written] == [s.edges.select("src", "dst").distinct().count()]


def test_the_search_for_routes_exchanges_no_edges_to_meet_its_target(spark, monkeypatch):
    edges = dealt(_edges(spark).repartition(3, "src"), "edges", ["src"], 3)
    joins, cut = [], traverse.cut

    def noted(df, name="step"):
        joins.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(traverse, "cut", noted)
    traverse.routes(edges, spark.createDataFrame([("P1",)], "node string"), "P9")
    first = next(p for p in joins if "Join" in p)
    assert "SortMergeJoin" not in first and "Exchange hashpartitioning(dst" not in first


def test_composed_scores_go_by_blocks_for_all_keys(spark):
    """Replicates and contexts of a profile, composed, are those of rows by key and context (F2, F3, F6)."""
    edges = _edges(spark)
    seeds = spark.createDataFrame([(1, "P1", 1.0), (1, "P2", 0.45), (2, "P2", 0.7), (2, "P3", -1.0), (2, "nowhere", 0.2)], "replicate int, node string, weight double")
    weights = score.context_weights(spark, {"author": 2.0, "venue": 0.0})
    p = score.transition(score.views(edges), ["view"], dealt=True).persist()
    rows = score.signed(p, seeds.crossJoin(p.select("view").distinct()), ["view", "replicate"], ["view"], score.return_diagonal(p, ["view"]))
    want = {(r.replicate, r.node): r.score for r in score.compose(rows.withColumnRenamed("view", "context"), weights, ["replicate"]).collect()}
    for given in (edges, dealt(edges.repartition(3, "src"), "edges", ["src"], 3)):
        found = rank.composed(given, seeds, weights, ["replicate"])
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        got = {(r.replicate, r.node): r.score for r in found.collect()}
        assert got.keys() == want.keys() and len(got) > 40
        assert all(abs(got[k] - want[k]) < 1e-14 for k in want)
    assert rank.composed(edges, seeds, score.context_weights(spark, {c: 0.0 for c in ENTITY_CONTEXTS}), ["replicate"]).count() == 0
