"""Readers and writers of the corpus's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import corpus

# The fields that are read of a full record and of a stub.
FULL = """id string, doi string, display_name string, publication_year int, publication_date string, cited_by_count long,
 authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, display_name: string, ror: string, country_code: string>>>>,
 primary_location struct<source: struct<id: string, display_name: string, type: string, issn_l: string, host_organization_name: string>>,
 topics array<struct<id: string, display_name: string, score: double>>, referenced_works array<string>,
 abstract_inverted_index map<string, array<int>>, type string, language string, open_access struct<is_oa: boolean>"""
STUB = "id string, display_name string, publication_year int, cited_by_count long, type string"
#: A larger BibTeX file is refused.
MOST_BIBTEX = 4 * 1024 * 1024
LAYOUT = "doc string, pos int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page int, col int"


def read_full(spark: SparkSession, path: str) -> DataFrame:
    """Full records from JSON lines, gzipped or not; records without an id are left out."""
    return spark.read.schema(FULL).json(path).where("id is not null")


def read_stubs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUB).json(path).where("id is not null")


def works(full: DataFrame, stubs: DataFrame) -> DataFrame:
    """The works of both, a full record before a stub of the same id."""
    a = full.select(
        tx.short_id(F.col("id")).alias("id"),
        F.left("display_name", F.lit(1000)).alias("title"),
        tx.rebuilt_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("publication_year").alias("year"),
        "cited_by_count",
        tx.bare_doi(F.col("doi")).alias("doi"),
        "type",
        F.left("language", F.lit(8)).alias("language"),
        F.coalesce(F.col("open_access.is_oa"), F.lit(False)).alias("is_oa"),
        F.lit(False).alias("is_stub"),
        tx.short_id(F.col("primary_location.source.id")).alias("venue_id"),
    )
    missing = {c: F.lit(None).cast("string") for c in ("abstract", "doi", "venue_id", "language")} | {"is_oa": F.lit(False)}
    b = stubs.select(tx.short_id(F.col("id")).alias("id"), F.col("display_name").alias("title"), F.col("publication_year").alias("year"), "cited_by_count", "type", F.lit(True).alias("is_stub"))
    b = b.withColumns(missing).join(a.select("id"), "id", "left_anti")
    # of records that repeat an id, the most cited one counts, then the least by its other columns
    first = lambda df: corpus.first_per_key(df, ["id"], [F.desc("cited_by_count"), *(c for c in df.columns if c not in ("id", "cited_by_count"))])
    return first(a).unionByName(first(b).select(*a.columns))


def citations(full: DataFrame) -> DataFrame:
    rows = full.select(tx.short_id(F.col("id")).alias("src_id"), F.explode("referenced_works").alias("ref"))
    return rows.select("src_id", tx.short_id(F.col("ref")).alias("dst_id")).where("src_id != dst_id").distinct()


def work_authors(full: DataFrame) -> DataFrame:
    rows = full.select(tx.short_id(F.col("id")).alias("work_id"), F.posexplode("authorships").alias("position", "a"))
    return rows.where("a.author.id is not null").select("work_id", tx.short_id(F.col("a.author.id")).alias("author_id"), "position").groupBy("work_id", "author_id").agg(F.min("position").alias("position"))


def work_topics(full: DataFrame) -> DataFrame:
    rows = full.select(tx.short_id(F.col("id")).alias("work_id"), F.explode("topics").alias("t"))
    return rows.select("work_id", tx.short_id(F.col("t.id")).alias("topic_id"), F.col("t.score").alias("score")).groupBy("work_id", "topic_id").agg(F.max("score").alias("score"))


def work_institutions(full: DataFrame) -> DataFrame:
    """(work_id, institution_id) of all authors' institutions, once each."""
    rows = full.select(tx.short_id(F.col("id")).alias("work_id"), F.explode("authorships").alias("a")).select("work_id", F.explode("a.institutions").alias("i"))
    return rows.where("i.id is not null").select("work_id", tx.short_id(F.col("i.id")).alias("institution_id")).distinct()


def dimensions(full: DataFrame) -> dict[str, DataFrame]:
    """The rows of authors, venues, topics and institutions, one for each id, with the least of each other column."""
    author = full.select(F.explode("authorships").alias("a"))
    rows = {
        "authors": author.select("a.author.id", "a.author.display_name", "a.author.orcid"),
        "venues": full.select("primary_location.source.id", "primary_location.source.display_name", F.left("primary_location.source.type", F.lit(32)).alias("type"), F.left("primary_location.source.issn_l", F.lit(16)).alias("issn_l"), F.col("primary_location.source.host_organization_name").alias("publisher")),
        "topics": full.select(F.explode("topics").alias("t")).select("t.id", "t.display_name"),
        "institutions": author.select(F.explode("a.institutions").alias("i")).select("i.id", "i.display_name", "i.ror", F.left("i.country_code", F.lit(8)).alias("country_code")),
    }
    return {name: df.where("id is not null").withColumn("id", tx.short_id(F.col("id"))).groupBy("id").agg(*(F.min(c).alias(c) for c in df.columns if c != "id")) for name, df in rows.items()}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_bibtex(spark: SparkSession, path: str, most_bytes: int = MOST_BIBTEX) -> DataFrame:
    """(file, entry, ref, doi, title, url) of the entries of BibTeX files, braces and escapes taken out.

    Files are read as UTF-8, or as Latin-1 if they are not valid; larger ones than ``most_bytes`` are left
    out (see :func:`refused_bibtex`). A file is cut into marks and what lies between; running sums give
    each mark its depth of braces, and whether it is inside quotes, so commas part fields only at the
    entry's own depth. Comments, preambles and string definitions are no entries. Fields that
    repeat a name count once, by their first; what follows an unclosed brace belongs to its entry.
    """
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    plain = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode("content", "ISO-8859-1"))
    return bibtex_entries(raw.select(F.col("path").alias("file"), text.alias("text")))


def refused_bibtex(spark: SparkSession, path: str, most_bytes: int = MOST_BIBTEX) -> DataFrame:
    """(file, reason) of files that hold too much; empty files are passed over by Spark's readers."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes)
    return files.select(F.col("path").alias("file"), F.lit("too large").alias("reason"))


def bibtex_entries(files: DataFrame) -> DataFrame:
    """The entries of (file, text), as :func:`read_bibtex` has them."""
    marks = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r'(?s)(\\.|[{}",@]|[^{}",@\\]+|\\$)'), F.lit(1))).alias("i", "t"))
    line = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a file is bounded
    change = F.when(F.col("t") == "{", 1).when(F.col("t") == "}", -1).otherwise(0)
    deep = marks.withColumn("after", F.sum(change).over(line)).withColumn("before", F.col("after") - change)
    # quotes count at an entry's own depth alone
    quoted = deep.withColumn("quotes", F.sum(F.when((F.col("t") == '"') & (F.col("before") == 1), 1).otherwise(0)).over(line) % 2)
    starts = quoted.withColumn("entry", F.sum(F.when((F.col("t") == "@") & (F.col("before") <= 0), 1).otherwise(0)).over(line))
    inner = Window.partitionBy("file", "entry").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    comma = (F.col("t") == ",") & (F.col("before") == 1) & (F.col("quotes") == 0)
    fields = starts.where("entry > 0").withColumn("field", F.sum(comma.cast("int")).over(inner)).where(~comma & ~((F.col("t") == "}") & (F.col("after") == 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x.t), "")
    parts = fields.where((F.col("before") > 0) | (F.col("field") == 0)).groupBy("file", "entry", "field").agg(joined.alias("raw"))
    name = F.lower(F.trim(F.regexp_replace(F.substring_index("raw", "=", 1), r"\s+", " ")))
    value = F.regexp_replace(F.expr("substring(raw, instr(raw, '=') + 1)"), r'^\s*"|"\s*$', "")
    clean = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(value, r"[{}\\]", ""), r"\s+", " ")), F.lit(""))
    head = F.when(F.col("field") == 0, F.col("raw"))

    def first(wanted: str):
        return F.min(F.when((F.col("field") > 0) & (name == wanted) & F.col("raw").contains("="), F.struct("field", clean.alias("v")))).v.alias(wanted)

    found = parts.groupBy("file", "entry").agg(F.max(head).alias("_head"), *(first(c) for c in ("doi", "title", "url")))
    kind, key = F.lower(F.trim(F.regexp_extract("_head", r"(?s)^@([^{]*)", 1))), F.trim(F.regexp_extract("_head", r"(?s)\{(.*)$", 1))
    known = found.withColumns({"_kind": kind, "ref": key}).where(~F.col("_kind").isin("comment", "preamble", "string", "") & (F.col("ref") != ""))
    return known.select("file", "entry", "ref", "doi", "title", "url")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).json(path)
