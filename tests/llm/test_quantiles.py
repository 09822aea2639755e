import bisect
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quantiles as qs


def values(seed=7):
    """(grp, part, x): a hot group, ties, a value with most of the rows, small groups, null keys."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(4), int(rng.expovariate(0.001))) for _ in range(6000)]
    rows += [("tied", rng.randrange(3), 5 if rng.random() < 0.97 else rng.randrange(40)) for _ in range(3000)]
    rows += [("few", 0, x) for x in (3, 1, 2, 2)] + [("one", 1, 9)] + [(None, 0, x) for x in range(30)] + [("gap", 2, None)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(values(), "grp string, part int, x long").repartition(5)


def plain():
    out = {}
    for g, p, x in values():
        if x is not None:
            out.setdefault((g, p), []).append(x)
    return {k: sorted(v) for k, v in out.items()}


def test_exact_ranks(frame):
    want = plain()
    got = {}
    for r in qs.exact_ranks(frame, ["grp", "part"], "x").collect():
        mine = want[r.grp, r.part]
        assert (r.below, r.upto, r.n) == (bisect.bisect_left(mine, r.x), bisect.bisect_right(mine, r.x), len(mine))
        distinct = sorted(set(mine))
        assert (r.order, r.distinct) == (distinct.index(r.x), len(distinct))
        got.setdefault((r.grp, r.part), set()).add(r.x)
    assert got == {k: set(v) for k, v in want.items()}


def test_bounds_hold_and_merges_nest(frame):
    want = plain()
    whole = {}
    for (g, _), v in want.items():
        whole.setdefault(g, []).extend(v)
    whole = {g: sorted(v) for g, v in whole.items()}
    single = qs.summarise(qs.exact_ranks(frame, ["grp", "part"], "x"), ["grp", "part"], "x", points=40, least=8).cache()
    for r in single.groupBy("grp", "part").count().collect():
        mine = want[r.grp, r.part]
        assert min(8, len(set(mine))) <= r["count"] <= min(len(mine), 49)
    # parts 0 and 1 first, cut to few points, then the rest beside them
    pair = F.when(F.col("part") < 2, 0).otherwise(F.col("part"))
    first = qs.merge(single.where("part < 2").withColumn("grp", F.coalesce("grp", F.lit("none"))), ["grp"], ["part"], "x", most=30).withColumn("part", F.lit(0))
    rest = single.where("part >= 2").withColumn("grp", F.coalesce("grp", F.lit("none"))).withColumn("part", pair)
    nested = qs.merge(first.unionByName(rest), ["grp"], ["part"], "x")
    for merged in (qs.merge(single, ["grp"], ["part"], "x"), qs.merge(single, ["grp"], ["part"], "x", most=25), nested):
        rows = merged.collect()
        assert rows
        for r in rows:
            mine = whole[None if r.grp == "none" else r.grp]
            below, upto = bisect.bisect_left(mine, r.x), bisect.bisect_right(mine, r.x)
            assert r.n == len(mine) and r.below_lo <= below <= r.below_hi and r.upto_lo <= upto <= r.upto_hi
        for r in qs.quantiles(merged, ["grp"], "x", 5).collect():
            mine = whole[None if r.grp == "none" else r.grp]
            below, upto = bisect.bisect_left(mine, r.answer), bisect.bisect_right(mine, r.answer)
            assert r.target == -(-r.i * len(mine) // 5)
            assert max(0, below + 1 - r.target, r.target - upto) <= r.bound
    assert max(r["count"] for r in qs.merge(single, ["grp"], ["part"], "x", most=25).groupBy("grp").count().collect()) <= 25


def test_streams_against_a_plain_count(spark):
    rng = random.Random(3)
    clicks = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.02 else round(rng.uniform(-3, 90), 2)) for i in range(900)]
    clicks += clicks[:40]
    items = [(i, f"B{i % 3}" if i else None, None if i == 4 else i * 1.25) for i in range(60)]
    lines = [(rng.randrange(70), rng.choice([None, 1, 2, 3, 44])) for _ in range(2500)] + [(7, 5)] * 900 + [(None, 1)]
    got = qs.stream_quantiles(
        qs.batched(
            qs.streams_of(
                spark.createDataFrame(clicks, "click_id long, client_id long, value double").withColumn("x", F.lit("clash")),
                spark.createDataFrame(lines, "item_id long, vendor_id long").withColumn("n", F.lit(1)),
                spark.createDataFrame(items, "item_id long, brand string, price double"),
            ),
            4,
        )
    ).collect()
    rows = [("value", str(c), i, v) for i, c, v in {c[0]: c for c in clicks}.values() if c is not None]
    known = {i: (b, p) for i, b, p in items}
    rows += [("price", known[i][0], v, known[i][1]) for i, v in lines if i in known and known[i][0] is not None]
    groups = {}
    for stream, grp, i, money in rows:
        if money is not None and money == money and abs(money) != float("inf"):
            batch = zlib.crc32(("" if i is None else str(i)).encode()) % 4
            x = int((100 * money + 0.5) // 1) + 1000 * batch
            groups.setdefault((stream, grp, batch), []).append(x)
            groups.setdefault((stream, grp, -1), []).append(x)
    groups = {k: sorted(v) for k, v in groups.items() if len(v) >= 20}
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == {(*k, i) for k in groups for i in (1, 2, 3)} and len(got) == 3 * len(groups)
    last = {}
    for r in sorted(got, key=lambda r: (r.stream, r.grp, r.batch, r.i)):
        mine = groups[r.stream, r.grp, r.batch]
        assert (r.n, r.target) == (len(mine), -(-r.i * len(mine) // 4)) and r.exact_x == mine[r.target - 1]
        assert (r.n_below, r.n_upto) == (bisect.bisect_left(mine, r.answer), bisect.bisect_right(mine, r.answer))
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto) <= r.bound
        assert r.within and min(10, len(set(mine))) <= r.points <= min(len(mine), 1000)
        assert mine[0] <= r.answer <= mine[-1] and r.answer >= last.get((r.stream, r.grp, r.batch), r.answer)
        last[r.stream, r.grp, r.batch] = r.answer


def test_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in ("click_id long, client_id long, value double", "item_id long, vendor_id long", "item_id long, brand string, price double")]
    assert qs.stream_quantiles(qs.batched(qs.streams_of(*empty), 4)).count() == 0
