"""Bibliographies out of layout lines.

Lines are (doc, pos, text, x0, y0, x1, y1, font_size, page, col), pos being the reading order and
col null outside columns. Every step is a window or an aggregate by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.plans.lineage import cut

# Thresholds of page furniture, splitting and acceptance.
FURNITURE_LENGTH, FURNITURE_PAGES = 60, 2
LEAST_ENTRIES, MOST_ENTRIES, LEAST_STRUCTURAL = 3, 400, 6
ENTRY_LENGTHS = (40, 400)
LEAST_AUTHOR, LEAST_YEAR, LEAST_ORDER = 0.5, 0.6, 0.9
SOLE_SCORE, MARGIN = 0.55, 0.12
MOST_TRIM, TAIL_SHARE, LEAST_TAIL_PAGES = 12, 0.4, 2
MARGIN_SLACK = 2.0
FONT_STEP, FONT_SLACK, FONT_LINES = 1.5, 0.5, 40
LEAST_KEYS, LEAST_KEY_SHARE = 8, 0.12
LEAST_RUN, LEAST_RUN_SHARE, MOST_MISSES = 8, 0.6, 3
LEAST_TAIL_CHARS = 200

# Patterns of keys, openings and signals.
HEADINGS = (
    "references", "reference", "bibliography", "works cited", "literature cited", "literature", "references cited",
    "bibliographie", "références", "referencias", "bibliografía", "literatur", "literaturverzeichnis", "bibliografia", "riferimenti",
    "referências", "литература", "список литературы", "参考文献",
)
ENDINGS = ("appendix", "appendices", "acknowledgements", "acknowledgments", "supplementary material", "supplement", "annex")
APPENDIX = r"(?i)^\s*(?:[A-Z]|[IVXLC]+)?\s*\.?\s*append(?:ix|ices)\b"
ANY_KEY = r"^\s*\[(\d{1,3}|[A-Z][a-zA-Z+\-]*\d{0,2}[a-z]?)\]"
AUTHORISH = (
    r"^\s*(?:\[[^\]]{1,12}\]|\d{1,3}\.|(?:[A-Z]\.\s*)+[A-Z][a-z]|"
    r"[A-Z][\w'À-ɏ-]+,?\s+(?:[A-Z]\.|[A-Z][a-z]|and\b|et\b)|"
    r"[A-Z][\w'À-ɏ-]+\s+[A-Z]{1,3}\b)"
)
BRACKET = r"^\s*\[(\d{1,3})\]"
ORDINAL = r"^\s*(\d{1,3})\.\s+\S"
ALPHA_KEY = r"[A-Z][a-zA-Z+\-]*\d{2}[a-z]?"
ALPHA = rf"^\s*\[({ALPHA_KEY})\]"
AUTHOR_OPEN = (
    r"(?U)^(?:(?:[A-Z]\.[\s-]*)+[A-Z][\w'À-ɏ-]+|"
    r"[A-Z][\w'À-ɏ-]+,?\s+(?:[A-Z]\.|[A-Z][a-z]+|and\b|et\b)|"
    r"[A-Z][\w'À-ɏ-]+\s+[A-Z]{1,3}\b|"
    r"(?:van|von|de|del|di|da)\s+[A-Z]|"
    r"[A-Z][\w'À-ɏ-]+\s+et\s+al)"
)
SIGNAL = r"(?i)\b(1[89]\d{2}|20[0-2]\d|2030)\b|arXiv|\bdoi\b|10\.\d{4,9}/|\d+\s*[:(]\s*\d+|\bpp?\.\s*\d"
VOLUME = r"(?i)(?:\d+\s*[:(]\s*\d+|\bpp?\.\s*\d|\bIn:|\bvol\.\s*\d)"
AUTHOR_YEAR = r"(?U)\(([A-Z][\w'À-ɏ-]+(?:\s+et\s+al\.?)?,?\s+(?:1[89]|20)\d{2})"
MARKERS = {"bracket_numeric": r"\[(\d{1,3})\]", "ordinal": r"\[(\d{1,3})\]", "alpha_key": rf"\[({ALPHA_KEY})\]", "indent": AUTHOR_YEAR}
LEAD_KEY = r"^\s*(\[[^\]]{1,16}\]|\d{1,3}\.)\s*"
METHODS = {"bracket_numeric": BRACKET, "ordinal": ORDINAL, "alpha_key": ALPHA}


def tail_pages(lines: DataFrame) -> DataFrame:
    """The last pages of each document: TAIL_SHARE of them, LEAST_TAIL_PAGES at the least."""
    last = F.max("page").over(Window.partitionBy("doc"))
    n = F.greatest(F.lit(LEAST_TAIL_PAGES), F.ceil(last * TAIL_SHARE))
    return lines.withColumn("_from", last - n).where("page > _from").drop("_from")


def furniture(lines: DataFrame) -> DataFrame:
    """(doc, text, pages): short lines that stand on two pages or more."""
    t = F.trim("text")
    short = lines.where((t != "") & (F.length(t) < FURNITURE_LENGTH))
    return short.groupBy("doc", t.alias("text")).agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= FURNITURE_PAGES)


def cleaned(lines: DataFrame) -> DataFrame:
    """Without page numbers, repeated short lines, and full-width lines of pages in columns."""
    in_columns = F.max(F.col("col").isNotNull()).over(Window.partitionBy("doc", "page"))
    out = lines.withColumn("_t", F.trim("text")).withColumn("_columns", in_columns)
    out = out.where(~F.col("_t").rlike(r"^(page\s*)?\d{1,4}$") & ~(F.col("col").isNull() & F.col("_columns")))
    repeated = furniture(lines).select("doc", F.col("text").alias("_t"))
    return out.join(repeated, ["doc", "_t"], "left_anti").drop("_t", "_columns")


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with pos by page, column, height and left edge."""
    w = Window.partitionBy("doc").orderBy("page", F.coalesce("col", F.lit(0)), "y0", "x0", "text")
    return lines.withColumn("pos", F.row_number().over(w))


def columns(lines: DataFrame) -> DataFrame:
    """(doc, page, split): where a page parts into two columns, null if it does not.

    The widest gap between neighbouring midpoints of lines of 12 to 72 percent of the width
    must be 4 percent at least, lie in the middle third or so, and leave a quarter on each side.
    """
    width = F.max("x1").over(Window.partitionBy("doc", "page"))
    votes = lines.withColumn("w", width).where(((F.col("x1") - F.col("x0")) / F.col("w")).between(0.12, 0.72)).withColumn("mid", (F.col("x0") + F.col("x1")) / 2 / F.col("w"))
    order = Window.partitionBy("doc", "page").orderBy("mid")
    gaps = votes.withColumns({"gap": F.col("mid") - F.lag("mid").over(order), "at": (F.col("mid") + F.lag("mid").over(order)) / 2, "left": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("doc", "page"))})
    best = gaps.where("n >= 8").groupBy("doc", "page").agg(F.max(F.struct("gap", "at", "left", "n")).alias("b"))
    ok = (F.col("b.gap") >= 0.04) & F.col("b.at").between(0.35, 0.65) & ((F.col("b.left") / F.col("b.n")).between(0.25, 0.75))
    return best.select("doc", "page", F.when(ok, F.round("b.at", 6)).alias("split"))


def heading(text: Column) -> Column:
    """A heading in lower case, without numbers before it, closing marks, and space between its letters."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[.:]+$", ""))
    t = F.regexp_replace(t, r"^[0-9ivxlc]+[.\s]+", "")
    spaced = t.rlike(r"(?U)^(?:\w\s+)+\w$")
    return F.when(spaced, F.regexp_replace(t, r"(?U)\s+", "")).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))


def reference_like(text: Column) -> Column:
    """Whether a line opens like an author list or a key and holds a year."""
    return text.rlike(tx.YEAR) & text.rlike(AUTHORISH)


def in_columns(lines: DataFrame) -> DataFrame:
    """Lines with col: as given, else 0 or 1 by the side of the page's split, and null for lines across it."""
    splits = columns(lines)
    at = F.col("split") * F.max("x1").over(Window.partitionBy("doc", "page"))
    side = F.when(F.col("x1") <= at + MARGIN_SLACK, 0).when(F.col("x0") >= at - MARGIN_SLACK, 1)
    return lines.join(splits, ["doc", "page"], "left").withColumn("col", F.coalesce("col", side)).drop("split")


def region(lines: DataFrame) -> DataFrame:
    """The lines of each document's bibliography: by heading, else by keys, else by the densest run; none if all fail."""
    found = cut(headed_region(lines), "region")  # each way reads what the ones before found
    for detect in (keyed_region, dense_region):
        rest = lines.join(found.select("doc").distinct(), "doc", "left_anti")
        found = found.unionByName(cut(detect(rest).select(*found.columns), "region"))
    return found


def headed_region(lines: DataFrame) -> DataFrame:
    """The lines after the last reference heading, up to the first line that ends such a section.

    Endings are known headings, an appendix, and, where the heading stands FONT_STEP above the middle
    size of the FONT_LINES lines after it, a line as large as the heading that is no reference.
    """
    w = Window.partitionBy("doc")
    is_head = F.when(heading(F.col("text")).isin(*HEADINGS), F.struct("pos", "font_size"))
    after = lines.withColumn("_head", F.max(is_head).over(w)).where(F.col("pos") > F.col("_head.pos"))
    nearest = F.row_number().over(w.orderBy("pos")) <= FONT_LINES
    sizes = F.array_sort(F.collect_list(F.when(F.col("_near") & (F.col("font_size") > 0), F.col("font_size"))).over(w))
    after = after.withColumn("_near", nearest).withColumn("_sizes", sizes)
    body = F.coalesce(F.try_element_at("_sizes", F.floor(F.size("_sizes") / 2).cast("int") + 1), F.lit(0.0))
    large = F.coalesce((F.col("_head.font_size") >= body + FONT_STEP) & (F.col("font_size") >= F.col("_head.font_size") - FONT_SLACK), F.lit(False))
    ends = heading(F.col("text")).isin(*ENDINGS) | F.col("text").rlike(APPENDIX) | (large & ~reference_like(F.col("text")))
    stop = F.min(F.when(ends, F.col("pos"))).over(w)
    return after.withColumn("_stop", stop).where("_stop is null or pos < _stop").drop("_head", "_near", "_sizes", "_stop")


def keyed_region(lines: DataFrame) -> DataFrame:
    """From the first line keyed [1] after which LEAST_KEYS lines, and LEAST_KEY_SHARE of all, start with a key."""
    rest = Window.partitionBy("doc").orderBy(F.desc("pos"))
    keyed = F.col("text").rlike(ANY_KEY).cast("int")
    counts = lines.withColumns({"_keys": F.sum(keyed).over(rest), "_lines": F.count("*").over(rest)})
    opens = (F.regexp_extract("text", ANY_KEY, 1) == "1") & (F.col("_keys") >= LEAST_KEYS) & (F.col("_keys") / F.col("_lines") >= LEAST_KEY_SHARE)
    first = F.min(F.when(opens, F.col("pos"))).over(Window.partitionBy("doc"))
    return counts.withColumn("_first", first).where("pos >= _first").drop("_keys", "_lines", "_first")


def dense_region(lines: DataFrame) -> DataFrame:
    """The longest run of reference-like lines with at most MOST_MISSES others between two of them.

    A run that reaches the document's end keeps the others after it. Of runs of one length the last
    counts; it needs LEAST_RUN lines, of which LEAST_RUN_SHARE are reference-like.
    """
    w = Window.partitionBy("doc")
    at = lines.withColumns({"_i": F.row_number().over(w.orderBy("pos")), "_n": F.count("*").over(w)})
    likely = at.where(reference_like(F.col("text")))
    new = F.when(F.col("_i") - F.lag("_i").over(w.orderBy("_i")) > MOST_MISSES + 1, 1).otherwise(0)
    run = likely.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.orderBy("_i")))
    runs = run.groupBy("doc", "_run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("hits"), F.first("_n").alias("n"))
    open_end = F.col("n") - F.col("last") <= MOST_MISSES
    runs = runs.withColumns({"to": F.when(open_end, F.col("n")).otherwise(F.col("last")), "length": F.when(open_end, F.col("n") + 1).otherwise(F.col("last")) - F.col("first")})
    best = runs.groupBy("doc").agg(F.max(F.struct("length", "first", "to", "hits")).alias("b"))
    size = F.col("b.to") - F.col("b.first") + 1
    best = best.where((size >= LEAST_RUN) & (F.col("b.hits") / size >= LEAST_RUN_SHARE))
    return at.join(best, "doc").where(F.col("_i").between(F.col("b.first"), F.col("b.to"))).drop("_i", "_n", "b")


def trimmed(lines: DataFrame) -> DataFrame:
    """Without closing lines that carry no sign of a reference; kept if they are more than MOST_TRIM."""
    w = Window.partitionBy("doc")
    good = F.col("text").rlike(SIGNAL) & ~F.contains("text", F.lit("@"))
    last = F.max(F.when(good, F.col("pos"))).over(w)
    extra = F.count(F.when(F.col("pos") > F.col("_last"), 1)).over(w)
    out = lines.withColumn("_last", F.coalesce(last, F.lit(0))).withColumn("_extra", extra)
    return out.where((F.col("pos") <= F.col("_last")) | (F.col("_extra") > MOST_TRIM)).drop("_last", "_extra")


def entries(lines: DataFrame) -> DataFrame:
    """(doc, method, entry, key, raw): each document's lines split by every kind of key, and by indent.

    A line that opens an entry starts a running number; the lines of a number are one entry.
    """
    margin = F.min("x0").over(Window.partitionBy("doc", "page", "col"))
    starts = [F.struct(F.lit(m).alias("method"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("key")) for m, p in METHODS.items()]
    opens = F.when((F.col("x0") <= F.col("_margin") + MARGIN_SLACK) & F.col("text").rlike(AUTHOR_OPEN), F.lit("-"))
    starts.append(F.struct(F.lit("indent").alias("method"), opens.alias("key")))
    tried = lines.withColumn("_margin", margin).withColumn("s", F.explode(F.array(*starts))).select("doc", "pos", "text", "s.method", "s.key")
    run = Window.partitionBy("doc", "method").orderBy("pos")
    numbered = tried.withColumn("entry", F.sum(F.when(F.col("key").isNotNull(), 1).otherwise(0)).over(run)).where("entry > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    out = numbered.groupBy("doc", "method", "entry").agg(F.max("key").alias("key"), joined.alias("raw"))
    return out.withColumn("raw", tx.without_pages(tx.tidy(F.col("raw")))).where("raw != ''")


def markers(body: DataFrame) -> DataFrame:
    """(doc, method, n_markers): distinct citation marks in the lines before the bibliography, for each way of splitting."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    whole = body.groupBy("doc").agg(text.alias("text"))
    counts = [F.struct(F.lit(m).alias("method"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("n_markers")) for m, p in MARKERS.items()]
    return whole.select("doc", F.explode(F.array(*counts)).alias("m")).select("doc", "m.*")


def features(found: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(doc, method, n_entries, ..., score, structural, failures) of each way of splitting.

    With ``marked``, of :func:`markers`, the score also averages how near the numbers of entries and of
    marks are, where there are marks.
    """
    body = F.regexp_replace("raw", LEAD_KEY, "")
    number = F.when(F.col("method").isin("bracket_numeric", "ordinal"), F.col("key").cast("int"))
    w = Window.partitionBy("doc", "method").orderBy("entry")
    rows = found.withColumns({"number": number, "before": F.lag(number).over(w), "place": F.row_number().over(w)})
    f = rows.groupBy("doc", "method").agg(
        F.count("*").alias("n_entries"),
        F.percentile(F.length("raw"), 0.5).alias("median_len"),
        F.avg(body.rlike(AUTHOR_OPEN).cast("double")).alias("author_frac"),
        F.avg(F.col("raw").rlike(tx.YEAR).cast("double")).alias("year_frac"),
        F.avg(F.col("raw").rlike(VOLUME).cast("double")).alias("volpage_frac"),
        F.avg(F.when(F.col("before").isNotNull(), (F.col("number") > F.col("before")).cast("double"))).alias("key_order"),
        F.bool_and(F.col("number") == F.col("place")).alias("in_sequence"),
        (F.countDistinct("key") == F.count("*")).alias("unique_keys"),
    )
    length_ok = F.col("median_len").between(*ENTRY_LENGTHS)
    parts = length_ok.cast("double") + F.col("author_frac") + F.col("year_frac") + F.col("volpage_frac")
    score = parts / 4
    if marked is not None:
        f = f.join(marked.where("n_markers > 0"), ["doc", "method"], "left")
        agreement = F.least("n_entries", "n_markers") / F.greatest("n_entries", "n_markers")
        f = f.withColumn("marker_agreement", agreement)
        score = F.when(F.col("n_markers").isNull(), parts / 4).otherwise((parts + agreement) / 5)
    structural = (F.col("n_entries") >= LEAST_STRUCTURAL) & F.when(F.col("method") == "alpha_key", F.col("unique_keys")).otherwise(F.coalesce("in_sequence", F.lit(False)))
    fails = F.filter(
        F.array(
            F.when(~length_ok, "length"),
            F.when(F.col("author_frac") < LEAST_AUTHOR, "authors"),
            F.when(F.col("year_frac") < LEAST_YEAR, "years"),
            F.when(F.col("n_entries") > MOST_ENTRIES, "too many"),
            F.when(F.col("n_entries") < LEAST_ENTRIES, "too few"),
            F.when(F.col("key_order") < LEAST_ORDER, "order"),
        ),
        lambda x: x.isNotNull(),
    )
    return f.withColumns({"score": F.round(score, 9), "structural": structural, "failures": F.array_join(fails, ",")})


def adjudicated(scored: DataFrame) -> DataFrame:
    """(doc, method, n_entries, score, accepted): structural splits first, else a clear best one.

    Without a structural split, the best that fails no gate must lead the next by MARGIN, or
    reach SOLE_SCORE if it is alone. Documents without an accepted split are refused.
    """
    w = Window.partitionBy("doc").orderBy(F.desc(F.col("structural") & (F.col("n_entries") >= LEAST_STRUCTURAL)), F.desc(F.col("failures") == ""), F.desc("score"), "method")
    next_score = F.lead(F.when(F.col("failures") == "", F.col("score"))).over(w)
    rows = scored.withColumns({"i": F.row_number().over(w), "next": next_score}).where("i = 1")
    clear = F.when(F.col("next").isNull(), F.col("score") >= SOLE_SCORE).otherwise(F.col("score") - F.col("next") >= MARGIN)
    ok = F.col("structural") | ((F.col("failures") == "") & clear)
    return rows.select("doc", "method", "n_entries", "score", ok.alias("accepted"))


def parsed(found: DataFrame) -> DataFrame:
    """``found`` with doi, arxiv, year and a guess at the title of each entry."""
    raw = F.col("raw")
    doi = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(raw, tx.DOI_IN_TEXT, 0), r"[.)\]]+$", "")), F.lit(""))
    return found.withColumns({"doi": doi, "arxiv": tx.arxiv_id(raw), "year": tx.last_year(raw), "title": tx.title_guess(F.regexp_replace(raw, LEAD_KEY, ""))})


def merged_keys(lines: DataFrame) -> DataFrame:
    """Lines whose key stands alone to their left, put together by vertical overlap."""
    bare = lines.where(F.col("text").rlike(r"^\s*(\[[^\]]{1,16}\]|\d{1,3}\.)\s*$")).select("doc", "page", F.col("pos").alias("key_pos"), F.trim("text").alias("key"), F.col("x1").alias("kx1"), F.col("y0").alias("ky0"), F.col("y1").alias("ky1"))
    pairs = lines.join(bare, ["doc", "page"]).where("pos != key_pos and x0 >= kx1 - 1.0")
    pairs = pairs.withColumn("overlap", F.least("ky1", "y1") - F.greatest("ky0", "y0")).where(F.col("overlap") > 0.5 * F.least(F.col("ky1") - F.col("ky0"), F.lit(1.0)))
    one = Window.partitionBy("doc", "key_pos").orderBy(F.desc("overlap"), "pos")
    other = Window.partitionBy("doc", "pos").orderBy("key_pos")
    best = pairs.withColumn("i", F.row_number().over(one)).where("i = 1").withColumn("j", F.row_number().over(other)).where("j = 1").select("doc", "pos", "key", "key_pos")
    used = best.select("doc", F.col("key_pos").alias("pos"))
    out = lines.join(used, ["doc", "pos"], "left_anti").join(best.select("doc", "pos", "key"), ["doc", "pos"], "left")
    return out.withColumn("text", F.concat_ws(" ", "key", "text")).drop("key")


def paper_title(lines: DataFrame) -> DataFrame:
    """(doc, title): the first run of lines in the largest font of the first page, 10 to 300 characters."""
    w = Window.partitionBy("doc")
    first = lines.where("page = 1").withColumn("_size", F.max("font_size").over(w)).withColumn("_run", F.row_number().over(w.orderBy("pos")))
    big = first.where("font_size = _size").withColumn("_island", F.col("_run") - F.row_number().over(w.orderBy("pos")))
    big = big.withColumn("_first", F.min("_island").over(w)).where("_island = _first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return big.groupBy("doc").agg(tx.tidy(text).alias("title")).where(F.length("title").between(10, 300))


def extract(lines: DataFrame) -> DataFrame:
    """(doc, method, entry, key, raw, doi, arxiv, year, title) of the documents that are accepted.

    Only the last pages are read, in reading order; documents with fewer than LEAST_TAIL_CHARS
    characters there, such as scans, are refused.
    """
    tail = cut(reading_order(in_columns(tail_pages(lines))), "tail")
    chars = F.sum(F.length("text")).over(Window.partitionBy("doc"))
    tail = tail.withColumn("_chars", chars).where(F.col("_chars") >= LEAST_TAIL_CHARS).drop("_chars")
    ready = cut(cleaned(region(tail)), "region")
    found = cut(entries(trimmed(merged_keys(ready))), "entries")
    chosen = adjudicated(features(found)).where("accepted")
    return parsed(found.join(chosen.select("doc", "method"), ["doc", "method"], "left_semi"))
