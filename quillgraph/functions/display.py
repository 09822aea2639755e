"""Column functions that put numbers, people and matches into words, and bars on a shared scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx

# Decimals without an error bar and at the most, padding and least width of bars.
PLAIN_DECIMALS, MOST_DECIMALS = 4, 8
PADDING, LEAST_WIDTH = 0.06, 0.01

# Labels and tones of how a reference was matched.
MATCHES = {
    "doi": ("matched by DOI", "positive"),
    "arxiv": ("matched by arXiv id", "positive"),
    "manual": ("matched by you", "positive"),
    "trigram": ("candidate (title match)", "accent"),
    "openalex": ("candidate (OpenAlex search)", "accent"),
    "none": ("unmatched", "neutral"),
}
UNCHECKED = ("couldn't check OpenAlex", "caution")


def fixed(x: Column, decimals: Column) -> Column:
    """``x`` with that many decimals, without separators."""
    return F.replace(F.call_function("format_number", x, decimals), F.lit(","), F.lit(""))


def decimals(error: Column) -> Column:
    """As many decimals as reach the first digit of the error; four without an error."""
    first = (-F.floor(F.log10(error))).cast("int")
    return F.when(F.coalesce(error, F.lit(0.0)) <= 0, PLAIN_DECIMALS).otherwise(F.least(F.lit(MOST_DECIMALS), F.greatest(F.lit(0), first)))


def score_text(x: Column, error: Column) -> Column:
    """A score to the decimals that its error allows; what they cannot show is '<' their unit."""
    places = decimals(error)
    unit = F.pow(F.lit(10.0), -places)
    return F.when((x != 0) & (F.abs(x) < unit), F.concat(F.lit("<"), fixed(unit, places))).otherwise(fixed(x, places))


def count_text(n: Column) -> Column:
    return F.call_function("format_number", F.round(n), F.lit(0))


def percentile_text(p: Column) -> Column:
    """A percentile, as a share or out of 100, as an ordinal; 100th is kept for the very top."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(p > 1, p / 100).otherwise(p))) * 100
    return F.when((v >= 99.5) & (v < 100), "99th").otherwise(tx.ordinal(F.round(v).cast("int")))


def people_text(names: Column, most: int = 3) -> Column:
    """The first names of a list and how many follow."""
    rest = F.size(names) - most
    first = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "Unattributed").when(rest > 0, F.concat(first, F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(first)


def search_title(title: Column) -> Column:
    """A title without the marks that part the clauses of a remote filter."""
    return F.trim(F.translate(title, ",:", "  "))


def match_words(method: Column, confidence: Column, has_work: Column, resolved: Column, unchecked: Column) -> Column:
    """A struct (label, tone, confidence, will_be_added, unmatched) on how a reference was matched."""
    added = ~has_work & resolved

    def told(which: int):
        out = F.when(unchecked, UNCHECKED[which])
        for name, words in MATCHES.items():
            out = out.when(method == name, words[which])
        return out

    sure = F.when(~unchecked & method.isin("trigram", "openalex"), confidence)
    missed = F.when(unchecked, ~has_work & ~added).otherwise((method == "none") & ~added)
    return F.struct(told(0).alias("label"), told(1).alias("tone"), sure.alias("confidence"), added.alias("will_be_added"), missed.alias("unmatched"))


def bars(rows: DataFrame, value: str = "score", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """``rows`` with bar_center, bar_low, bar_high, clipped and shade (0 to 1) on one scale for all.

    The scale holds every band and PADDING on both sides, or half a unit if it has no width. The
    shade is the value between the least and the largest; if all are one value, that over itself.
    """
    ends = rows.agg(F.min(F.least(low, value)).alias("_a"), F.max(F.greatest(high, value)).alias("_b"), F.min(value).alias("_v"), F.max(value).alias("_w"))
    pad = F.when(F.col("_a") == F.col("_b"), 0.5).otherwise((F.col("_b") - F.col("_a")) * PADDING)
    flat = F.col("_v") == F.col("_w")
    ends = ends.select((F.col("_a") - pad).alias("_lo"), (F.col("_b") + pad).alias("_hi"), F.when(flat, 0.0).otherwise(F.col("_v")).alias("_v"), F.when(flat & (F.col("_w") == 0), 1.0).otherwise(F.col("_w")).alias("_w"))
    at = lambda x: (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    inside = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    out = rows.crossJoin(F.broadcast(ends))  # one row
    a, b = at(F.least(low, high)), at(F.greatest(low, high))
    out = out.withColumns({"clipped": (a < 0) | (b > 1), "bar_center": inside(at(F.col(value))), "bar_low": inside(a), "bar_high": inside(b)})
    thin = F.col("bar_high") - F.col("bar_low") < LEAST_WIDTH
    out = out.withColumn("bar_high", F.when(thin, F.least(F.lit(1.0), F.col("bar_low") + LEAST_WIDTH)).otherwise(F.col("bar_high")))
    return out.withColumn("shade", (F.col(value) - F.col("_v")) / (F.col("_w") - F.col("_v"))).drop("_lo", "_hi", "_v", "_w")
