from pyspark.sql import functions as F

from quillgraph.operators import search, state
from quillgraph.plans import upkeep
from quillgraph.sources import files

BIB = r'''Some words before, with "quotes" and a {brace}.
@article{key1, title = {A {Nested {Deep}} Title, with = signs}, doi = {10.1/ABC}, year = 1999}
@string{jan = "January"} @comment{title = {not one}}
@Book{key2,
  title = "Quoted, {with "inner" braces} and, commas",
  url = {https://doi.org/10.2/xyz},
}
@misc{one-line,title={Plain}}@misc{two, note = {a \{ brace and \" a quote}, title = {After {\"o} an escape}}
@misc{twice, title = {First}, title = {Second}}
@misc{open, title = {Never closed
'''


def test_entries_by_depth(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB, encoding="utf-8")
    (tmp_path / "b.bib").write_bytes("@misc{latin, title = {Caf\u00e9 na\u00efve}}".encode("latin-1"))
    (tmp_path / "c.bib").write_bytes(b"")
    (tmp_path / "d.bib").write_bytes(b"@misc{big, title = {Too large}}" + b" " * 5000)
    got = {r.ref: (r.title, r.doi, r.url) for r in files.read_bibtex(spark, str(tmp_path), most_bytes=5000).collect()}
    assert got == {
        "key1": ("A Nested Deep Title, with = signs", "10.1/ABC", None),
        "key2": ('Quoted, with "inner" braces and, commas', None, "https://doi.org/10.2/xyz"),
        "one-line": ("Plain", None, None),
        "two": ('After "o an escape', None, None),
        "twice": ("First", None, None),
        "open": ("Never closed", None, None),
        "latin": ("Caf\u00e9 na\u00efve", None, None),
    }
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in files.refused_bibtex(spark, str(tmp_path), 5000).collect()} == {("d.bib", "too large")}


def test_import_keeps_what_is_trusted(spark):
    entries = spark.createDataFrame([("a", "10.1000/ABC", None, None), ("b", None, "Nearly the same tittle", None), ("c", None, None, "http://x"), ("d", None, "Mine already", "https://doi.org/10.9999/q")], "ref string, doi string, title string, url string")
    works = spark.createDataFrame([("W1", "https://doi.org/10.1000/abc", "Other"), ("W2", None, "Nearly the same title"), ("W3", "10.9999/Q", "zzz")], "id string, doi string, title string")
    trust = spark.createDataFrame([("W3", 5, False)], "work_id string, strength int, is_distrust boolean")
    matches, after = state.import_bibliography(entries, works, trust)
    assert {(r.ref, r.label, r.work_id, r.method, r.added) for r in matches.collect()} == {("a", "a", "W1", "doi", True), ("b", "Nearly the same tittle", "W2", "title", True), ("c", "c", None, None, False), ("d", "Mine already", "W3", "doi", False)}
    assert {tuple(r) for r in after.collect()} == {("W3", 5, False), ("W1", 3, False), ("W2", 3, False)}


def test_titles_that_are_equal_need_no_candidates(spark):
    """Equal trigrams go to the least id, within a year if years count; the others by candidates as before."""
    titles = spark.createDataFrame([(i, f"Steel bolt of kind {i // 2}", 1990 + i) for i in range(40)], "id long, title string, year int")
    queries = titles.select(F.col("id").alias("query"), F.upper("title").alias("text"), (F.col("year") - 1).alias("year"))
    found = search.trigram_matches(queries, titles, 0.5)
    assert {(r.query, r.id, r.similarity) for r in found.collect()} == {(i, i // 2 * 2, 1.0) for i in range(40)}
    near = {r.query: (r.id, r.similarity) for r in search.trigram_matches(queries.where("query in (6, 7)"), titles, 0.95, years=True).collect()}
    assert near == {6: (6, 1.0), 7: (6, 1.0)}  # a year before 1997 is 1996, that of number 6
    other = spark.createDataFrame([(1, "steel bolts of kind 7"), (2, "??"), (3, None)], "query long, text string")
    assert {(r.query, r.id) for r in search.trigram_matches(other, titles, 0.5).collect()} == {(1, 14)}


def test_large_bibliographies_are_cut_into_files_that_are_read(spark, tmp_path):
    """40,000 parts of one brand stand in several files, all below the reader's bound."""
    part = spark.range(1, 40_001).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("BOLT").alias("p_type"), F.lit(5).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    for name in ("customer", "supplier", "orders", "lineitem", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert upkeep.bibtex_import(spark, str(tmp_path)).where("work_id is not null").count() == 40_000


def test_a_title_word_for_word_goes_before_one_of_the_same_trigrams(spark):
    """Bolt 1111 and bolt 11111 have the same trigrams; each entry is matched to its own (F13)."""
    works = spark.createDataFrame([("P1111", "bolt 1111"), ("P11111", "bolt 11111"), ("P2", "??")], "id string, title string").selectExpr("id", "cast(null as string) as doi", "title")
    entries = spark.createDataFrame([("a", "bolt 1111"), ("b", "bolt 11111"), ("c", "Bolt 111111"), ("d", "??")], "ref string, title string").selectExpr("ref", "cast(null as string) as doi", "title", "cast(null as string) as url")
    trust = spark.createDataFrame([], "work_id string, strength int, is_distrust boolean")
    matches, _ = state.import_bibliography(entries, works, trust)
    assert {(r.ref, r.work_id, r.method) for r in matches.collect()} == {("a", "P1111", "title"), ("b", "P11111", "title"), ("c", "P1111", "title"), ("d", None, None)}
