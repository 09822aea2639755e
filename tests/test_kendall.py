import random

import numpy as np
import pytest

from quillgraph.operators import resample


def test_inversions():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 17, 200):
        x = [rng.randrange(9) for _ in range(n)]
        assert resample.inversions(np.array(x)) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("block", [7, 100_000])
def test_kendall_against_pairs(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 2.0, 2.0, 3.0, rng.random()]), float(rng.randrange(12))) for _ in range(150)] + [(5.0, 1.0)] * 60 + [(None, 1.0), (1.0, None)]
    used = [r for r in rows if None not in r]
    sign = lambda x, y: (x > y) - (x < y)
    pairs = [(sign(p[0], q[0]), sign(p[1], q[1])) for i, p in enumerate(used) for q in used[i + 1 :]]
    tau = sum(s * t for s, t in pairs) / (sum(s != 0 for s, _ in pairs) * sum(t != 0 for _, t in pairs)) ** 0.5
    r = resample.kendall(spark.createDataFrame(rows, "p double, q double").repartition(4), "p", "q", block).first()
    assert (r.n, r.discordant, r.tau) == (len(used), sum(s * t < 0 for s, t in pairs), pytest.approx(tau))


def test_all_ties_and_nothing(spark):
    assert resample.kendall(spark.createDataFrame([(1.0, 2.0)] * 4, "p double, q double"), "p", "q").first().tau is None
    assert tuple(resample.kendall(spark.createDataFrame([], "p double, q double"), "p", "q").first()) == (0, 0, None)
