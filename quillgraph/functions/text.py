"""Column functions on titles, identifiers and bibliography entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers and years.
DOI = r"10\.\d{4,9}/\S+"
DOI_IN_TEXT = r"10\.\d{4,9}/[^\s,;]+"
DOI_URL = r"^https?://(dx\.)?doi\.org/"
ARXIV_NEW = r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})"
ARXIV_OLD = r"(?i)arxiv[:\s]*([a-z-]+(?:\.[a-z]{2})?/\d{7})"
YEAR = r"\b(1[89]\d{2}|20[0-2]\d|2030)\b"


def short_id(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def rebuilt_abstract(index: Column, most: int = 8000) -> Column:
    """The text of a map from words to their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.left(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(most))


def normal_doi(text: Column) -> Column:
    """The DOI in a text, without escapes and closing punctuation, in lower case; null if none."""
    found = F.regexp_extract(F.replace(text, F.lit("\\"), F.lit("")), DOI, 0)
    return F.nullif(F.lower(F.regexp_replace(found, r"[.,;)\]]+$", "")), F.lit(""))


def bare_doi(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, DOI_URL, ""))


def last_year(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), F.lit(-1)).cast("int")


def arxiv_id(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, ARXIV_NEW, 1), F.lit("")), F.nullif(F.regexp_extract(text, ARXIV_OLD, 1), F.lit("")))


def title_guess(text: Column) -> Column:
    """The first sentence after the authors that is 15 to 300 characters long.

    Without one, the sentence after a year in brackets, as author-year styles have it.
    """
    parts = F.split(text, r"(?<=[.?!])\s+")
    fit = F.filter(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: F.length(x).between(15, 300))
    dated = F.trim(F.regexp_extract(text, r"\((?:1[89]|20)\d{2}[a-z]?\)\.?\s*(.+?)(?:[.?!]\s|$)", 1))
    found = F.coalesce(F.try_element_at(fit, F.lit(1)), F.when(F.length(dated).between(15, 300), dated))
    return F.regexp_replace(found, r"[.,;]+$", "")


def tidy(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens gone, words broken at line ends joined, spaces single."""
    out = text
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("­", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_pages(text: Column) -> Column:
    """Without a closing page range that follows a separator."""
    return F.regexp_replace(text, r"[,;:]\s*(pp?\.\s*)?\d+\s*[-–]\s*\d+\.?\s*$", "")


def decade(year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def words(text: Column) -> Column:
    """The words of letters and digits of a text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text, each word with two spaces before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def verdict(score: Column, stderr: Column) -> Column:
    """How tight a band is: by the error relative to the score."""
    relative = stderr / F.abs(score)
    return F.when(score == 0, "uninformative").when(relative < 0.15, "tight").when(relative < 0.5, "loose").otherwise("uninformative")


def disagreement_band(x: Column) -> Column:
    return F.when(x < 0.2, "agree").when(x < 0.45, "lean").when(x < 0.7, "differ").otherwise("split")


def diversity_band(x: Column) -> Column:
    q = F.round(x / 0.05) * 0.05
    return F.when(q < 0.2, "very low").when(q < 0.4, "low").when(q < 0.6, "medium").when(q < 0.8, "high").otherwise("very high")


def novelty_word(x: Column) -> Column:
    return F.when(x <= 0.25, "close").when(x <= 0.5, "near").when(x <= 0.75, "far").otherwise("remote")


def ordinal(n: Column) -> Column:
    ten, one = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    end = F.when(ten.between(11, 13), "th").when(one == 1, "st").when(one == 2, "nd").when(one == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def signed_rank(delta: Column) -> Column:
    return F.when(delta == 0, "no change").when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
