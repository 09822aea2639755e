"""Search with every word of the queries, fused with the merit of every document."""

import duckdb
import pytest

from quillgraph.operators import search
from quillgraph.plans import oracles, queries

SF = "/root/testdata/sf0.01"


def answer(sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", ["text_rank", "rrf_fuse"])
def test_whole_queries(spark, name):
    found, expected = sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())), sorted(answer(oracles.ORACLES[name]))
    assert found and len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert [float(x) if not isinstance(x, str) else 0 for x in a] == pytest.approx([float(x) if not isinstance(x, str) else 0 for x in b], abs=2e-9)


def test_papers_without_merit_stand_behind(spark):
    found = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 0), (1, 3, 0.7, 0)], "query long, id long, rank double, cited long")
    merit = spark.createDataFrame([(3, 5.0), (2, 1.0)], "id long, score double")
    out = {r.id: (r.text_rank, r.merit_rank) for r in search.rrf(found, merit).collect()}
    assert out == {1: (1, 3), 2: (2, 2), 3: (3, 1)}
