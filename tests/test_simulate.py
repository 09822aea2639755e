"""Moves over full rankings."""

from quillgraph.operators import rank, score
from quillgraph.plans import queries

SF = "/root/testdata/sf0.001"


def full(spark, s, last):
    """{node: (rank, score)} of every visible paper by the first ``last`` trusted papers."""
    p = s.transition()
    found = score.signed(p, rank.seed_weights(s.trust.where(f"pos <= {last}")), [], back=score.return_diagonal(p))
    shown = {r.node: round(r.score, 12) + 0.0 for r in rank.visible(found, s.works, s.trust).collect()}
    return {n: (i, shown[n]) for i, n in enumerate(sorted(shown, key=lambda n: (-shown[n], n)), 1)}


def test_simulate_moves_beyond_rank_50(spark):
    s = queries._Setting(spark, SF)
    a, b = full(spark, s, 6), full(spark, s, 5)
    far = len(a) + len(b) + 1
    every = {n: (a.get(n, (far, 0))[0], b.get(n, (far, 0))[0], round(b.get(n, (0, 0.0))[1] - a.get(n, (0, 0.0))[1], 9)) for n in a.keys() | b.keys()}
    moved = sorted(((n, x, y, x - y, d) for n, (x, y, d) in every.items() if x != y or d), key=lambda m: (-abs(m[3]), -abs(m[4]), m[0]))[:100]
    found = [tuple(r) for r in queries.simulate_moves(spark, SF).collect()]
    assert max(max(m[1:3]) for m in moved) > 51
    assert [m[:4] for m in sorted(found)] == [m[:4] for m in sorted(moved)]
    assert all(abs(x[4] - y[4]) < 2e-9 for x, y in zip(sorted(found), sorted(moved), strict=True))


def test_missing_papers_stand_beyond_both(spark):
    a = spark.createDataFrame([("P1", 1, 0.9), ("P2", 2, 0.5)], "node string, rank int, score double")
    b = spark.createDataFrame([("P2", 1, 0.8)], "node string, rank int, score double")
    found = {r.node: (r.rank_after, r.delta_rank) for r in rank.moves(a, b, beyond_both=True).collect()}
    assert found == {"P1": (4, -3), "P2": (1, 1)}
