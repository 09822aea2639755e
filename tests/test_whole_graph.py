"""Queries over the whole graph, similarity edges included, against their SQL."""

import duckdb
import pytest

from quillgraph.plans import oracles, queries

SF = "/root/testdata/sf0.001"


def answer(sql):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


def key(row):
    return tuple(str(x) for x in row if not isinstance(x, float))


def same(found, expected):
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [key(r) for r in found] == [key(r) for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a == pytest.approx(b, abs=2e-9) if all(isinstance(x, (int, float)) for x in a) else [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=2e-9)


def test_the_setting_has_similarity_edges(spark):
    found = {r.relation for r in queries._Setting(spark, SF).edges.select("relation").distinct().collect()}
    assert {"couples", "co_cited"} <= found


@pytest.mark.parametrize("name", ["transition", "propagate_signed", "explain_paths", "blindspots", "recommendations", "eval_recall"])
def test_whole_graph(spark, name):
    same(queries.QUERIES[name](spark, SF).collect(), answer(oracles.ORACLES[name]))
