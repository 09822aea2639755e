"""Ranks, shares and runs over a table in many parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ordered, resample, state


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def values():
    drawn = random.Random(3)
    return [(f"n{i:03}", None if i % 17 == 0 else float(drawn.randrange(12)), drawn.random() * 1.5) for i in range(200)]


def test_ranks_and_shares(many_parts, values):
    df = many_parts.createDataFrame(values, "node string, v double, e double")
    assert ordered._parted(df, ["node"]).select("_part").distinct().count() > 1
    key = lambda r: (r[1] is None, -(r[1] or 0), r[0])
    want = {r[0]: i for i, r in enumerate(sorted(values, key=key), 1)}
    assert {r.node: r.rank for r in resample.ranked(df, "v").collect()} == want

    low = lambda x: float("-inf") if x is None else x
    n = len(values)
    at = {r[0]: sum(low(o[1]) <= low(r[1]) for o in values) for r in values}
    below = {r[0]: sum(low(o[1]) < low(r[1]) for o in values) for r in values}
    assert {r.node: r.p for r in resample.percentile(df, "v", "p").collect()} == pytest.approx({k: x / n for k, x in at.items()})
    assert {r.node: r.p for r in resample.strict_percentile(df, "v", "p").collect()} == pytest.approx({k: x / n for k, x in below.items()})
    mean = {k: (below[k] + 1 + at[k]) / 2 for k in at}
    assert {r.node: r.p for r in ordered.with_average_rank(df, "v", "p").collect()} == pytest.approx(mean)


def test_runs_go_on_over_the_edges_of_parts(many_parts, values):
    rows = [(i, v if v is not None else 3.0, e) for i, (_, v, e) in enumerate(values)]
    df = many_parts.createDataFrame(rows, "position long, v double, e double")
    group, want = 0, []
    for before, here in zip([None, *rows], rows, strict=False):
        group += before is not None and abs(here[1] - before[1]) > (here[2] + before[2]) / 2
        want.append(group)
    assert [r.tie_group for r in resample.tie_groups(df, "v", "e", "position").orderBy("position").collect()] == want

    runs, want = resample.tie_runs(df.withColumn("g", F.col("v")), "g", "position").orderBy("run").collect(), []
    for p, v, _ in rows:
        if want and want[-1][1] == v:
            want[-1][3] = p
        else:
            want.append([len(want) + 1, v, p, p])
    assert [[r.run, r.tie_group, r.first, r.last] for r in runs] == want


def test_empty_and_local_ids(many_parts):
    none = many_parts.createDataFrame([], "node string, v double")
    assert resample.ranked(none, "v").count() == resample.percentile(none, "v", "p").count() == 0
    assert resample.tie_groups(none.withColumns({"e": F.lit(0.1), "position": F.lit(1)}), "v", "e", "position").count() == 0
    made = state.local_ids(7, many_parts.createDataFrame([("b",), ("a",), ("c",)], "k string"), ["k"])
    assert sorted((r.k, r.id) for r in made.collect()) == [("a", "CL8"), ("b", "CL9"), ("c", "CL10")]
