"""Hand-computed micro-graphs."""

import math

import pytest

from quillgraph.operators import graph, rank, resample, score, traverse
from quillgraph.schema import EDGES


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, float(w), c, r) for a, b, w, c, r in pairs], EDGES)


def simple(spark, *pairs):
    return edges(spark, *[(a, b, w, "citation", "cites") for a, b, w in pairs])


def test_transition_sums_parallel_edges(spark):
    p = score.transition(edges(spark, ("P1", "P2", 1, "citation", "cites"), ("P1", "P2", 1, "author", "wrote"), ("P1", "P3", 2, "citation", "cites")))
    assert rows(p, "src", "dst", "p") == [("P1", "P2", 0.5), ("P1", "P3", 0.5)]


def test_return_diagonal_of_a_two_cycle(spark):
    p = score.transition(simple(spark, ("P1", "P2", 1), ("P2", "P1", 1), ("P2", "P3", 1)))
    assert rows(score.return_diagonal(p), "node", "back") == [("P1", 0.5), ("P2", 0.5)]


def test_seeds_absorb_and_never_score(spark):
    p = score.transition(simple(spark, ("P1", "P2", 1), ("P2", "P1", 1), ("P2", "P3", 1)))
    seeds = spark.createDataFrame([("P1", 1.0)], "node string, weight double")
    found = dict(rows(score.signed(p, seeds, [], back=score.return_diagonal(p)), "node", "score"))
    assert found == pytest.approx({"P2": 0.85, "P3": 0.85**2 * 0.5})


def test_distrust_mirrors_trust(spark):
    p = score.transition(simple(spark, ("P1", "P2", 1), ("P2", "P3", 1)))
    back = score.return_diagonal(p)
    plus, minus = (dict(rows(score.signed(p, spark.createDataFrame([("P1", w)], "node string, weight double"), [], back=back), "node", "score")) for w in (1.0, -1.0))
    assert plus and minus == {k: -v for k, v in plus.items()}


def test_compose_is_a_weighted_mean_over_present_contexts(spark):
    scores = spark.createDataFrame([("author", "ego", 1.0), ("author", "P1", 0.4), ("topic", "ego", 1.0), ("topic", "P1", 0.2), ("topic", "P2", 0.6), ("venue", "ego", 1.0)], "context string, node string, score double")
    weights = spark.createDataFrame([("author", 1.0), ("topic", 3.0), ("venue", 5.0)], "context string, weight double")
    found = dict(rows(score.compose(scores, weights), "node", "score"))
    assert found["P1"] == pytest.approx((0.4 + 3 * 0.2) / 4)
    assert found["P2"] == pytest.approx(0.6)
    zero = spark.createDataFrame([("author", 0.0), ("topic", 0.0)], "context string, weight double")
    assert score.compose(scores, zero).count() == 0


def test_single_context_selection_is_not_empty(spark):  # citation alone must rank by citation
    assert dict(rows(score.context_weights(spark, only="citation"), "context", "weight"))["citation"] == 1.0
    with pytest.raises(ValueError):
        score.context_weights(spark, {"coupling": 1.0})
    with pytest.raises(ValueError):
        score.context_weights(spark, {"author": 6.0})


def test_dedupe_keeps_the_strongest_and_the_first_of_equals(spark):
    e = edges(spark, ("P1", "P2", 0.3, "citation", "co_cited"), ("P1", "P2", 1.0, "citation", "cites"), ("P1", "P3", 0.2, "citation", "couples"), ("P1", "P3", 0.2, "citation", "cited_by"))
    assert rows(graph.dedupe(e), "dst", "weight", "relation") == [("P2", 1.0, "cites"), ("P3", 0.2, "cited_by")]


def test_coupling_counts_hubs_in_the_union_only(spark):
    refs = [(c, f"P{k}") for c in ("C1", "C2") for k in range(3)]
    hub = [(f"C{i}", "P9") for i in range(1, 6)]
    more = [("C1", "P7")]
    cit = spark.createDataFrame(refs + hub + more, "src_id string, dst_id string")
    found = rows(graph.coupling(cit, cap=4), "src", "dst", "weight")
    assert [(a, b) for a, b, _ in found] == [("C1", "C2"), ("C2", "C1")]
    assert found[0][2] == pytest.approx(0.35 * 3 / 5)  # P0..P2 of the five references P0, P1, P2, P7, P9


def test_epoch_factor(spark):
    df = spark.createDataFrame([(2026,), (1966,), (1800,), (None,), (0,), (2030,)], "year int")
    found = [r[0] for r in df.select(graph.epoch_factor(df.year)).collect()]
    assert found == pytest.approx([1.0, 0.5, 0.4, 1.0, 1.0, 1.0])


def test_tie_groups_split_up_and_down(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1), (2, 0.95, 0.1), (3, 0.5, 0.1), (4, 0.5, 0.0), (5, 0.9, 0.1)], "position int, v double, se double")
    assert [r.tie_group for r in resample.tie_groups(df, "v", "se", "position").orderBy("position").collect()] == [0, 0, 1, 1, 2]


def test_jackknife_of_two_units(spark):
    full = spark.createDataFrame([("P1", 0.5)], "node string, score double")
    part = spark.createDataFrame([(1, "P1", 0.4)], "replicate int, node string, score double")
    r = resample.jackknife(full, part, 2, 2).first()
    assert r.stderr == pytest.approx(0.2)  # spread of 0.4 and 0
    assert r.ci_low == pytest.approx(0.5 - 1.96 * 0.2)
    assert resample.jackknife(full, part, 2, 1).first().stderr == pytest.approx(0.25)


def test_replicates_are_evenly_spaced(spark):
    units = spark.createDataFrame([(f"u{i:02d}",) for i in range(13)], "unit string")
    found = rows(resample.replicates(units), "replicate", "unit")
    assert len(found) == 12 and found[0] == (1, "u00")
    assert resample.replicates(units.limit(2)).count() == 2


def test_units_of_uploads(spark):
    trust = spark.createDataFrame([("P1", 1), ("P2", 2), ("P3", 3)], "work_id string, strength int")
    sources = spark.createDataFrame([("P1", 2), ("P1", 1), ("P2", 1)], "work_id string, upload_id long")
    assert rows(resample.trust_units(trust, sources), "work_id", "unit") == [("P1", "u:1"), ("P2", "u:1"), ("P3", "w:P3")]


def test_distances_and_paths(spark):
    e = simple(spark, ("P1", "P2", 0.5), ("P2", "P3", 0.5), ("P1", "P3", 0.1), ("P4", "P3", 1))
    seeds = spark.createDataFrame([("P1",)], "node string")
    assert rows(traverse.distances(e, seeds), "node", "distance") == [("P1", 0), ("P2", 1), ("P3", 1)]
    found = rows(traverse.paths(e, seeds, "P3"), "path", "weight", "contribution")
    # the way through P2 is never found: P1 was met on the first level
    assert found == [("P1 > P3", 0.1, 1.0)]


def test_path_contributions_sum_to_one(spark):
    e = simple(spark, ("P1", "P3", 0.3), ("P2", "P3", 0.1))
    found = traverse.paths(e, spark.createDataFrame([("P1",), ("P2",)], "node string"), "P3").collect()
    assert sum(r.contribution for r in found) == pytest.approx(1.0)
    assert [r.seed for r in found] == ["P1", "P2"]


def test_subgraph_has_no_dangling_edges(spark):
    e = edges(spark, ("P1", "P2", 1, "citation", "cites"), ("P1", "A1", 1, "author", "authored_by"), ("P5", "P6", 1, "citation", "cites"))
    core = spark.createDataFrame([("P1",)], "node string")
    assert rows(traverse.subgraph(e, core, 10, kinds=["paper"]), "src", "dst") == [("P1", "P2")]


def test_moves_up_are_positive(spark):
    a = spark.createDataFrame([("P1", 1, 0.9), ("P2", 2, 0.5)], "node string, rank int, score double")
    b = spark.createDataFrame([("P2", 1, 0.8)], "node string, rank int, score double")
    found = {r.node: (r.delta_rank, r.delta_score) for r in rank.moves(a, b).collect()}
    assert found["P2"] == (1, pytest.approx(0.3)) and found["P1"][0] == -1


def test_entropy_of_even_and_single_categories(spark):
    obs = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "a")], "dimension string, category string")
    found = {r.dimension: r for r in rank.entropy(obs, "dimension", "category").collect()}
    assert found["x"].entropy == pytest.approx(math.log(2), abs=1e-9) and found["x"].normalised == 1.0
    assert found["y"].entropy == 0 and found["y"].normalised == 0


def test_blindspots_hide_stubs_and_trusted(spark):
    works = spark.createDataFrame([("P1", False), ("P2", True), ("P3", False)], "id string, is_stub boolean")
    trust = spark.createDataFrame([("P3", 1, False)], "work_id string, strength int, is_distrust boolean")
    merit = spark.createDataFrame([("P1", 0.1), ("P2", 0.2), ("P3", 0.3)], "node string, score double")
    found = rank.blindspots(merit.limit(0), merit, works, trust).collect()
    assert [r.node for r in found] == ["P1"] and found[0].gap > 0


def test_pagerank_sums_to_one(spark):
    p = score.transition(simple(spark, ("P1", "P2", 1), ("P2", "P3", 1)))
    found = score.pagerank(p, spark.createDataFrame([("P1", 1.0)], "node string, mass double"), rounds=6)
    assert sum(r.score for r in found.collect()) == pytest.approx(1.0)
