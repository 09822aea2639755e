import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import porter
from quillgraph.functions import text as tx
from quillgraph.operators import biblio, corpus, evaluate, search, state
from quillgraph.plans import layouts
from quillgraph.sources import files


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_identifiers(spark):
    assert value(spark, tx.normal_doi, r"see 10.1000/A\_b(1).") == "10.1000/a_b(1"
    assert value(spark, tx.normal_doi, "none") is None
    assert value(spark, tx.bare_doi, "https://dx.doi.org/10.1/X") == "10.1/x"
    assert value(spark, tx.arxiv_id, "arXiv:2101.00001") == "2101.00001"
    assert value(spark, tx.last_year, "1999 and (2005), 2099") == 2005
    assert value(spark, tx.short_id, "https://x.org/W12") == "W12"
    assert value(spark, tx.tidy, "ﬁrst hyphen-\nated  text") == "first hyphenated text"
    assert value(spark, tx.title_guess, "A. Author. A title that is long enough. Journal 3.") == "A title that is long enough"


def test_rebuilt_abstract(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},)], "m map<string, array<int>>")
    assert df.select(tx.rebuilt_abstract(F.col("m"))).first()[0] == "a b a b"


def test_similarity_bounds(spark):
    df = spark.createDataFrame([("word", "word"), ("word", "two words"), ("", "x")], "a string, b string")
    found = [r[0] for r in df.select(tx.similarity(tx.trigrams(F.col("a")), tx.trigrams(F.col("b")))).collect()]
    assert found[0] == 1.0 and 0 < found[1] < 1 and found[2] == 0


def test_trigram_candidates_lose_nothing(spark):
    names = ["alpha beta", "alpha betas", "gamma delta", "alpine beta", "beta", "delta gamma ray", "alphabet"]
    titles = spark.createDataFrame(list(enumerate(names)), "id long, title string")
    queries = spark.createDataFrame([(100 + i, n.replace("a", "o", 1)) for i, n in enumerate(names)], "query long, text string")
    for threshold in (0.2, 0.55):
        a, b = queries.withColumn("g", tx.trigrams(F.col("text"))), titles.withColumn("h", tx.trigrams(F.col("title")))
        best: dict = {}
        for r in a.crossJoin(b).select("query", "id", tx.similarity(F.col("g"), F.col("h")).alias("s")).collect():
            if r.s >= threshold and (r.query not in best or (-r.s, r.id) < best[r.query]):
                best[r.query] = (-r.s, r.id)
        assert rows(search.trigram_matches(queries, titles, threshold), "query", "id") == sorted((q, i) for q, (_, i) in best.items())


def test_rrf_of_absent_merit(spark):
    text = spark.createDataFrame([("q", "a", 2.0, 0), ("q", "b", 1.0, 0)], "query string, id string, rank double, cited int")
    merit = spark.createDataFrame([("b", 0.5)], "id string, score double")
    found = {r.id: (r.position, r.rrf, r.merit_rank) for r in search.rrf(text, merit).collect()}
    assert found["a"] == (2, pytest.approx(1 / 61 + 1 / 62), 2) and found["b"] == (1, pytest.approx(1 / 62 + 1 / 61), 1)


def test_all_terms_are_needed(spark):
    docs = spark.createDataFrame([("d1", "red ring", "a ring of red"), ("d2", "", "red"), ("d3", "ring", "red red")], "id string, title string, body string")
    q = spark.createDataFrame([(1, "red"), (1, "ring")], "query int, term string")
    found = dict(rows(search.text_rank(search.postings(docs), q), "id", "rank"))
    assert set(found) == {"d1", "d3"} and found["d1"] > found["d3"]


def test_stemmer(spark):
    assert [value(spark, porter.stem, w) for w in ("rankings", "walked", "studies", "graphs", "class")] == ["rank", "walk", "studi", "graph", "class"]


def test_reference_matching_order(spark):
    works = spark.createDataFrame([("P1", "On rings and widgets", 2001, "10.1000/a"), ("P2", "A theory of bolts", 2002, None), ("P3", "Deep gears", 2020, "10.48550/arxiv.2001.00001")], "id string, title string, year int, doi string")
    refs = spark.createDataFrame([(1, "doi 10.1000/A.", "x", 1990), (2, "arXiv:2001.00001", None, None), (3, "bolts", "A theory of bolt", 2003), (4, "bolts", "A theory of bolt", 2010)], "ref int, raw string, title string, year int")
    assert rows(search.match_references(refs, works), "ref", "work_id", "method", "decision") == [(1, "P1", "doi", "accept"), (2, "P3", "arxiv", "accept"), (3, "P2", "title", "pending"), (4, None, "none", "pending")]


def test_bibliographies(spark):
    lines = layouts.frame(spark)
    found = biblio.adjudicated(biblio.features(biblio.entries(biblio.trimmed(biblio.cleaned(biblio.region(lines))))))
    got = {r.doc: (r.method, r.n_entries, r.accepted) for r in found.collect()}
    assert got["numeric"] == ("bracket_numeric", 8, True)
    assert got["indent"] == ("indent", 7, True)
    assert "prose" not in got or not got["prose"][2]
    parsed = biblio.extract(lines).where("doc = 'numeric' and entry = 1").first()
    assert parsed.year == 1991 and parsed.key == "1"


def test_detached_keys_join_their_lines(spark):
    lines = spark.createDataFrame([("d", 1, "[1]", 10.0, 0.0, 20.0, 8.0, 9.0, 1, None), ("d", 2, "A. Author, title", 30.0, 1.0, 90.0, 9.0, 9.0, 1, None), ("d", 3, "more", 30.0, 20.0, 90.0, 28.0, 9.0, 1, None)], files.LAYOUT)
    assert [r.text for r in biblio.merged_keys(lines).orderBy("pos").collect()] == ["[1] A. Author, title", "more"]


def test_two_columns(spark):
    lines = [("d", i, "t", x, 10.0 * i, x + 40.0, 10.0 * i + 8, 9.0, 1, None) for i, x in enumerate([5.0, 55.0] * 6, 1)]
    assert biblio.columns(spark.createDataFrame(lines, files.LAYOUT)).first().split == pytest.approx(0.526316)


def test_confirm_and_undo_leave_no_trace(spark):
    trust = spark.createDataFrame([("P1", 3, False)], "work_id string, strength int, is_distrust boolean")
    sources = spark.createDataFrame([], "work_id string, upload_id long, created_trust boolean")
    citations = spark.createDataFrame([("C1", "P1")], "src_id string, dst_id string")
    refs = spark.createDataFrame([(7, 0, "P1", "accept", 4, False), (7, 1, "P2", "accept", 4, False), (7, 2, "P3", "pending", 4, False), (7, 3, "P4", "accept", 4, True)], "upload_id long, idx int, work_id string, decision string, strength int, is_self_citation boolean")
    after = state.confirm(trust, sources, citations, refs, 7, "CL1")
    assert rows(after["trust"], "work_id", "strength") == [("P1", 3), ("P2", 4)]
    assert rows(after["sources"], "work_id", "created_trust") == [("P1", False), ("P2", True)]
    back = state.undo(after["trust"], after["sources"], after["citations"], 7, "CL1")
    assert rows(back["trust"], "work_id", "strength") == [("P1", 3)] and back["sources"].count() == 0
    assert rows(back["citations"], "src_id", "dst_id") == [("C1", "P1")]


def test_trust_survives_another_source(spark):
    trust = spark.createDataFrame([("P2", 4, False)], "work_id string, strength int, is_distrust boolean")
    sources = spark.createDataFrame([("P2", 7, True), ("P2", 8, False)], "work_id string, upload_id long, created_trust boolean")
    back = state.undo(trust, sources, spark.createDataFrame([], "src_id string, dst_id string"), 7, None)
    assert back["trust"].count() == 1


def test_state_changes(spark):
    trust = spark.createDataFrame([("P1", 3, False), ("P2", 1, False)], "work_id string, strength int, is_distrust boolean")
    new = spark.createDataFrame([("P1", 0, False), ("P3", 5, True)], "work_id string, strength int, is_distrust boolean")
    assert rows(state.set_trust(trust, new), "work_id", "strength") == [("P2", 1), ("P3", 5)]
    ups = spark.createDataFrame([(1, 1, b"x"), (2, 1, b"x"), (3, 2, b"x")], "id int, profile_id int, payload binary")
    assert state.new_uploads(ups, spark.createDataFrame([], "profile_id int, content_hash string")).count() == 2
    refs = spark.createDataFrame([(1, 0, None, "pending"), (1, 1, "P1", "accept")], "upload_id int, idx int, work_id string, decision string")
    patched = state.patch_references(refs, spark.createDataFrame([(1, 0, "P9", "accept")], "upload_id int, idx int, work_id string, decision string"))
    assert rows(patched, "idx", "work_id", "decision") == [(0, "P9", "accept"), (1, "P1", "accept")]
    assert rows(state.counters(refs), "n_parsed", "n_matched", "n_unresolved") == [(2, 1, 1)]


def test_upsert_is_idempotent(spark):
    have = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = corpus.upsert(have, new, ["id"])
    assert rows(once, "id", "v") == rows(corpus.upsert(once, new, ["id"]), "id", "v") == [("a", 1), ("b", 3), ("c", 4)]


def test_json_corpus(spark, tmp_path):
    full = {"id": "https://x.org/W1", "doi": "https://doi.org/10.1/A", "display_name": "T", "publication_year": 2000, "cited_by_count": 3, "authorships": [{"author": {"id": "https://x.org/A1", "display_name": "N"}, "institutions": []}], "primary_location": {"source": {"id": "https://x.org/S1"}}, "topics": [{"id": "https://x.org/T1", "display_name": "t", "score": 0.5}], "referenced_works": ["https://x.org/W2", "https://x.org/W1"], "abstract_inverted_index": {"hello": [0], "world": [1]}}
    with gzip.open(tmp_path / "full.jsonl.gz", "wt") as f:
        f.write(json.dumps(full) + "\n" + json.dumps({"display_name": "no id"}) + "\n")
    with gzip.open(tmp_path / "stub.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "https://x.org/W2", "display_name": "S"}) + "\n" + json.dumps({"id": "https://x.org/W1"}) + "\n")
    a, b = files.read_full(spark, str(tmp_path / "full.jsonl.gz")), files.read_stubs(spark, str(tmp_path / "stub.jsonl.gz"))
    assert rows(files.works(a, b), "id", "is_stub", "doi", "abstract") == [("W1", False, "10.1/a", "hello world"), ("W2", True, None, None)]
    assert rows(files.citations(a), "src_id", "dst_id") == [("W1", "W2")]
    assert rows(files.work_authors(a), "work_id", "author_id", "position") == [("W1", "A1", 0)]
    assert rows(files.work_topics(a), "topic_id", "score") == [("T1", 0.5)]
    files.write_json(files.citations(a), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{key1,\n title = {A {Nested} Title},\n doi = {10.1/x},\n}\n@book{key2,\n title = "Other",\n}\n')
    assert rows(files.read_bibtex(spark, str(tmp_path / "a.bib")), "ref", "title") == [("key1", "A Nested Title"), ("key2", "Other")]


def test_leaks_go_both_ways(spark):
    edges = spark.createDataFrame([("P1", "P2", 1.0, "citation", "couples"), ("P2", "P1", 1.0, "citation", "co_cited"), ("P1", "P2", 3.0, "citation", "cites"), ("P1", "P3", 1.0, "citation", "couples"), ("P3", "P1", 1.0, "citation", "couples")], "src string, dst string, weight double, context string, relation string")
    folds = spark.createDataFrame([("C1", "P1", True), ("C1", "P2", False), ("C2", "P1", True), ("C2", "P4", False)], "paper string, ref string, held boolean")
    touched, own = evaluate.ablation(edges, folds)
    assert rows(touched, "paper", "node") == [("C1", "P1"), ("C1", "P2")]
    assert rows(own, "paper", "node", "dst", "p") == [("C1", "P1", "P2", 0.75), ("C1", "P1", "P3", 0.25)]
