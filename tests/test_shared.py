import random
from collections import Counter
from itertools import combinations

import pytest

from quillgraph.operators import graph, shared


def _links(spark, groups):
    return spark.createDataFrame([(f"k{k}", f"m{m}") for k, group in enumerate(groups) for m in group], "key string, member string")


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_pairs_against_a_plain_count(spark, at_once):
    draw = random.Random(3)
    groups = [sorted(draw.sample(range(40), draw.choice([0, 1, 2, 5, 9]))) for _ in range(300)] + [list(range(60))]
    counts = Counter(frozenset(p) for group in groups for p in combinations(group, 2))
    found = shared.pairs(_links(spark, groups), "key", "member", 3, sent=at_once, counted=at_once).collect()
    assert len(found) == len({frozenset((r.a, r.b)) for r in found})
    assert {frozenset((int(r.a[1:]), int(r.b[1:]))): r.n for r in found} == {p: n for p, n in counts.items() if n >= 3}
    of = spark.createDataFrame([("m3",), ("m50",), ("none",)], "member string")
    some = shared.pairs(_links(spark, groups), "key", "member", 1, of, sent=at_once, counted=at_once).collect()
    assert {frozenset((int(r.a[1:]), int(r.b[1:]))): r.n for r in some} == {p: n for p, n in counts.items() if p & {3, 50}}
    assert shared.pairs(_links(spark, [[1], [2]]), "key", "member").count() == 0


def test_pairs_pass_in_a_few_bytes(spark):
    """No exchange holds rows of pairs: what leaves a task is one binary for each bucket."""
    plan = graph.coupling(spark.createDataFrame([(f"C{i}", f"P{j}") for i in range(30) for j in range(4)], "src_id string, dst_id string"))._jdf.queryExecution().toString()
    assert "explode(slice" not in plan and "applyInArrow" in plan.replace("FlatMapGroupsInArrow", "applyInArrow")
