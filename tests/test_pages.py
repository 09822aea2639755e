"""Pages and state changes against their SQL, on the smallest tables."""

import duckdb
import pytest

from quillgraph.operators import pages
from quillgraph.plans import pages as queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["paper_detail", "trust_diversity", "match_references", "trust_after_undo", "words_for_scores"])
def test_pages(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = ", ".join(found.columns)
    assert plain(found.collect()) == plain(con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())


def test_fallback_only_where_no_text_answers(spark):
    titles = spark.createDataFrame([(1, "graph walks"), (2, "graph walk")], "id long, title string")
    index = spark.createDataFrame([(1, "graph", "A", 1), (1, "walks", "A", 1), (2, "graph", "A", 1), (2, "walk", "A", 1)], "id long, term string, class string, tf long")
    asked = spark.createDataFrame([(1, "graph walks"), (2, "grph walk"), (3, None), (4, "zzz")], "query long, text string")
    assert sorted((r.query, r.id, r.method) for r in pages.find(index, titles, asked).collect()) == [(1, 1, "text"), (2, 2, "title")]
