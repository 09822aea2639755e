import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, k, every):
    """Each query's k best (score, id) by all inner products."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-float((x * q).sum()), j) for j, x in good if j != i and len(x) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(spark, rows, k, every):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % every == 0, k=k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = neighbours.hadamard(x)
    assert np.allclose((y**2).sum(axis=1), (x**2).sum(axis=1))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(y, x @ h / 4)


def test_first_probe_is_the_own_cell():
    for functions in (1, 2, 3):
        hasher = neighbours.Hasher(20, functions, 3)
        x = np.random.default_rng(2).normal(size=(40, 20))
        unit = hasher.asked(x)
        cells = hasher.cells(unit)
        for t in range(3):
            probes = hasher.probes(unit, t, 50)
            assert (probes[:, 0] == cells[:, t]).all()
            assert all(len(set(p)) == 50 for p in probes.tolist())


def test_lifted_angles_follow_inner_products():
    hasher = neighbours.Hasher(7, 1, 1)
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(30, 7)) * rng.uniform(0.1, 5, size=(30, 1)), rng.normal(size=(1, 7))
    longest = np.sqrt((x**2).sum(axis=1)).max()
    lifted = hasher.lifted(x, longest)
    assert np.allclose((lifted**2).sum(axis=1), 1)
    assert (np.argsort(lifted @ hasher.asked(q)[0]) == np.argsort(x @ q[0])).all()


def test_recall_and_order(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 24)) * 0.6
    x *= rng.uniform(0.5, 2, size=(1500, 1))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    want, got = truth(rows, 10, 10), found(spark, rows, 10, 10)
    assert got.keys() == want.keys()
    hits = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / len(want[i]) for i in want])
    assert hits >= 0.9
    flat = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows}
    for i, near in got.items():
        assert len(near) == 10 and near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(s == float((flat[i] * flat[j]).sum()) for j, s in near)


def test_copies_ties_and_rows_that_take_no_part(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(60)] + [(100, None, 0), (101, [], 0), (102, [0.0, 0.0, 0.0], 0), (103, [1.0, float("nan"), 0.0], 0), (104, [None, 1.0, 2.0], 0), (None, same, 0), (105, [float("inf"), 1.0, 1.0], 0)]
    rows += [(200, [9.0, 9.0, 9.0], 0), (201, [-1.0, 0.0, 0.0], 0), (210, [1.0, 1.0], 0), (220, [2.0, 1.0], 0), (30, same, 1)]
    want, got = truth(rows, 5, 10), found(spark, rows, 5, 10)
    assert {i: v for i, v in got.items() if i != 30} == {i: v for i, v in want.items() if i != 30}
    assert got[0][0] == (200, 54.0) and [j for j, _ in got[0][1:]] == [1, 2, 3, 4]
    assert len(got[210]) == 1  # vectors of other lengths don't meet


def test_nothing(spark):
    assert found(spark, [], 5, 10) == {}
    assert found(spark, [(1, [1.0], 0)], 5, 10) == {}
    assert found(spark, [(10, [1.0], 0)], 5, 10) == {}
