import tempfile

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import snapshots
from quillgraph.schema import EDGES
from quillgraph.sources import pages


def edges(spark, *rows):
    return spark.createDataFrame([(s, d, float(w), "citation", r) for s, d, w, r in rows], EDGES)


def seen(df):
    return sorted((r.src, r.dst, r.weight, r.relation) for r in df.collect())


def test_versions_and_pushes(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="quill-snap-")
    assert snapshots.version(spark, folder) is None
    assert snapshots.publish(edges(spark, ("a", "b", 1, "cites")), folder) == 1
    more = edges(spark, ("a", "b", 0.5, "couples"), ("b", "a", 2, "couples")).withColumn("push", F.lit("one"))
    assert snapshots.push(more, folder) == 2
    want = [("a", "b", 1.0, "cites"), ("b", "a", 2.0, "couples")]
    assert seen(snapshots.read(spark, folder)) == want
    assert snapshots.push(more, folder) == 2  # again: nothing changes
    assert seen(snapshots.read(spark, folder, 1)) == [("a", "b", 1.0, "cites")]
    broken = edges(spark, ("x", "y", 1, "cites")).withColumn("weight", F.expr("weight / assert_true(false)").cast("double"))
    with pytest.raises(Exception):  # noqa: B017
        snapshots.publish(broken, folder)
    assert snapshots.version(spark, folder) == 2 and seen(snapshots.read(spark, folder)) == want
    assert snapshots.publish(edges(spark, ("n", "m", 1, "cites")), folder) == 4  # numbers of broken writes aren't used again


def test_reconcile_is_repeatable(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="quill-snap-")
    snapshots.publish(edges(spark, ("a", "b", 1, "cites")), folder)
    uploads = spark.createDataFrame([(1, "engine_pending"), (2, "confirmed"), (3, "draft")], "upload_id long, status string")
    own = edges(spark, ("L1", "a", 1, "cites")).withColumn("upload_id", F.lit(1)).unionByName(edges(spark, ("L3", "a", 1, "cites")).withColumn("upload_id", F.lit(3)))
    for _ in range(2):
        after = snapshots.reconcile(uploads, own, folder)
        assert {(r.upload_id, r.status) for r in after.collect()} == {(1, "confirmed"), (2, "confirmed"), (3, "draft")}
        assert snapshots.version(spark, folder) == 2
        assert seen(snapshots.read(spark, folder)) == [("L1", "a", 1.0, "cites"), ("a", "b", 1.0, "cites")]
    assert snapshots.push(own.limit(0).withColumn("push", F.lit("x")).drop("upload_id"), folder) == 2


def test_pages_take_filters(spark, capsys):
    folder = tempfile.mkdtemp(prefix="quill-pages-") + "/pages"
    rows = [(f"W{i}", f't"{i}\n' if i % 3 else None, i % 50, ("article", "book", None)[i % 3], None if i % 10 == 9 else 1990 + i % 5) for i in range(600)]
    works = spark.createDataFrame(rows, "id string, title string, cited_by_count long, type string, year int")
    pages.write_pages(works, "file://" + folder, per_page=10)
    df = pages.read_pages(spark, "file://" + folder)
    got = {(r.id, r.title, r.cited_by_count, r.type, r.year) for r in df.collect()}
    assert got == {(i, t, c, k or "", -1 if y is None else y) for i, t, c, k, y in rows}
    asked = df.where("year > 1991 and year <= 1993 and type in ('book', 'article') and cited_by_count >= 20")
    want = {r[0] for r in rows if r[4] in (1992, 1993) and r[3] and r[2] >= 20}
    assert {r.id for r in asked.collect()} == want
    # only the pages of those types and years were opened: a task for each
    pages_of = df.where("year in (1992, 1993)").where("type in ('article', 'book')").select("type", "year", "page").distinct().count()
    assert asked.rdd.getNumPartitions() == pages_of < df.rdd.getNumPartitions()
    asked.explain("formatted")
    assert "PushedFilters" in capsys.readouterr().out
    for r in df.groupBy("type", "year", "page").agg(F.max("cited_by_count").alias("hi"), F.min("cited_by_count").alias("lo")).where("page = 1").collect():
        assert r.hi <= df.where((F.col("type") == r.type) & (F.col("year") == r.year) & (F.col("page") == 0)).agg(F.min("cited_by_count")).first()[0]
        break
    assert pages.read_pages(spark, "file://" + folder).where("year = 1800").count() == 0


def test_very_many_pages_share_tasks(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="quill-pages-") + "/pages"
    works = spark.range(600).select(F.concat(F.lit("W"), "id").alias("id"), F.lit("t").alias("title"), F.col("id").alias("cited_by_count"), F.lit("book").alias("type"), F.lit(1990).alias("year"))
    pages.write_pages(works, folder, per_page=1)
    df = pages.read_pages(spark, folder)
    assert df.rdd.getNumPartitions() == 300 and df.select("id", "page").distinct().count() == 600
