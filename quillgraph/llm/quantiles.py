"""Mergeable quantile summaries: evenly spaced order statistics with rank intervals.

Exact ranks come from a range sort of the distinct values: rows are counted by value first, the
counts are parted by ranges of (keys, value), so a key with a third of the rows is cut into many
parts, running sums are taken inside each part, and a part's offset is the sum of the same key's
earlier parts. Of the ranked values a summary keeps those that stand at evenly spaced ranks.

A summary is a set of points ``(value, below_lo, below_hi, upto_lo, upto_hi)``: bounds on how many
of its rows lie below the value, and at or below it. Where summaries are merged, each gives bounds
for the values that it lacks: from its next lower point (all up to that lie below) and its next
higher one (no more than what is below that). The bounds of the merged points are the sums, taken
as running sums of each point's steps, and the outcome is a summary again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import scratch

#: Points of a summary: ranks 1 and ceil(j * n / POINTS), and so many evenly spaced distinct values.
POINTS, LEAST_POINTS = 200, 10


def exact_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, below, upto, order, n, distinct), written once: the exact ranks of each distinct value.

    ``below`` and ``upto`` count the rows of the same keys under the value, and up to it; ``order``
    counts the smaller distinct values; ``n`` and ``distinct`` are the totals of the keys. Null keys
    are a group like any other, null values are left out, an empty frame gives an empty one.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return ranks_of_counts(counts, keys, value)


def ranks_of_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As :func:`exact_ranks`, of distinct (keys, value) that stand ``_c`` times each."""
    parted = counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    inner = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # ranges are sampled: written once, so that every later read sees the same parts
    local = scratch.table(parted.withColumns({"_upto": F.sum("_c").over(inner), "_order": F.count("*").over(inner)}), "ranked")
    parts = local.groupBy(*keys, "_part").agg(F.sum("_c").alias("_rows"), F.count("*").alias("_values"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a key
    whole = Window.partitionBy(*keys)
    zero = F.lit(0).cast("long")
    offsets = parts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_rows_before"),
        F.coalesce(F.sum("_values").over(earlier), zero).alias("_values_before"),
        F.sum("_rows").over(whole).alias("n"),
        F.sum("_values").over(whole).alias("distinct"),
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.col("_rows_before") + F.col("_upto")
    out = local.join(offsets, same).select(
        *keys, value, (upto - F.col("_c")).alias("below"), upto.alias("upto"), (F.col("_values_before") + F.col("_order") - 1).alias("order"), "n", "distinct"
    )
    return scratch.table(out, "ranks")


def _passes(before: str, upto: Column, total: str, steps: int) -> Column:
    """Whether one of the ranks ceil(j * total / steps) lies above ``before`` and at or below ``upto``."""
    return F.floor(upto * steps / F.col(total)) > F.floor(F.col(before) * steps / F.col(total))


def summarise(ranks: DataFrame, keys: list[str], value: str, points: int = POINTS, least: int = LEAST_POINTS) -> DataFrame:
    """(keys, value, below_lo, below_hi, upto_lo, upto_hi, n): a summary for each keys of :func:`exact_ranks`.

    Kept are the values at rank 1 and at ranks ceil(j * n / points), and ``least`` evenly spaced
    distinct ones, or all if there are fewer, so that a value with most of the rows leaves others in.
    Bounds of a single summary are exact, so lower and upper ones agree.
    """
    kept = (F.col("below") == 0) | _passes("below", F.col("upto"), "n", points) | _passes("order", F.col("order") + 1, "distinct", least)
    return ranks.where(kept).select(*keys, value, F.col("below").alias("below_lo"), F.col("below").alias("below_hi"), F.col("upto").alias("upto_lo"), F.col("upto").alias("upto_hi"), "n")


def merge(summaries: DataFrame, keys: list[str], part: list[str], value: str, most: int | None = None) -> DataFrame:
    """One summary for each ``keys`` out of all of its summaries, which ``part`` tells apart.

    Only the points are read. With ``most`` (at least 2), a merged summary of more points keeps the
    best ones for evenly spaced ranks, its first and its last; intervals stay valid. A group is as
    large as its summaries are together, whatever the rows behind them.
    """
    own = Window.partitionBy(*keys, *part).orderBy(value)
    placed = summaries.repartition(*keys).select(
        *keys,
        *part,
        value,
        "below_lo",
        "below_hi",
        "upto_lo",
        "upto_hi",
        "n",
        F.coalesce(F.lag("upto_lo").over(own), F.lit(0).cast("long")).alias("_last"),
        F.lead("below_hi").over(own).alias("_next"),
        (F.row_number().over(own) == 1).alias("_first"),
    )
    # what a summary's bounds gain at a point, and just after it
    steps = {
        "_bl_at": F.col("below_lo") - F.col("_last"),
        "_bl_after": F.col("upto_lo") - F.col("below_lo"),
        "_ul_at": F.col("upto_lo") - F.col("_last"),
        "_bh_after": F.coalesce("_next", "n") - F.col("below_hi"),
        "_uh_at": F.col("upto_hi") - F.col("below_hi"),
        "_uh_after": F.coalesce("_next", "n") - F.col("upto_hi"),
        "_start": F.when(F.col("_first"), F.col("below_hi")).otherwise(0),
        "_n": F.when(F.col("_first"), F.col("n")).otherwise(0),
    }
    joined = placed.groupBy(*keys, value).agg(*(F.sum(c).alias(name) for name, c in steps.items()))
    line = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    under = line.rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(under), F.lit(0).cast("long"))

    start = F.sum("_start").over(whole)
    out = joined.select(
        *keys,
        value,
        (F.sum("_bl_at").over(upto) + before("_bl_after")).alias("below_lo"),
        (start + before("_bh_after")).alias("below_hi"),
        F.sum("_ul_at").over(upto).alias("upto_lo"),
        (start + F.sum("_uh_at").over(upto) + before("_uh_after")).alias("upto_hi"),
        F.sum("_n").over(whole).alias("n"),
    )
    return out if most is None else _thinned(out, keys, value, most)


def _thinned(summaries: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """At most ``most`` points of each summary: first, last, and one for each of most - 2 steps of rank."""
    line = Window.partitionBy(*keys).orderBy(value)
    count = F.count("*").over(Window.partitionBy(*keys))
    middle = (F.col("below_hi") + F.col("upto_lo")) / 2.0
    step = F.least(F.lit(most - 3), F.floor(middle * (most - 2) / F.col("n"))).alias("_step")
    marked = summaries.select("*", count.alias("_count"), F.row_number().over(line).alias("_at"), step)
    ends = F.col("_at").isin(1) | (F.col("_at") == F.col("_count"))
    chosen = F.row_number().over(Window.partitionBy(*keys, "_step").orderBy(ends.cast("int"), F.abs(middle - (F.col("_step") + 0.5) * F.col("n") / (most - 2)), value)) == 1
    return marked.withColumn("_chosen", chosen).where((F.col("_count") <= most) | ends | F.col("_chosen")).drop("_count", "_at", "_step", "_chosen")


def quantiles(summaries: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """(keys, i, n, target, points, answer, bound) for i in 1 to parts - 1 of each summary.

    ``target`` is the exact rank ceil(i * n / parts). ``answer`` is the point whose interval can be
    the least far from it, the smaller one of equals, and ``bound`` is how far at the most; answers
    do not fall as i grows.
    """
    def target(i: int) -> Column:
        return F.floor((i * F.col("n") + (parts - 1)) / parts).cast("long")

    def nearest(i: int) -> Column:
        far = F.greatest(F.lit(0).cast("long"), F.col("below_hi") + 1 - target(i), target(i) - F.col("upto_lo"))
        return F.min(F.struct(far.alias("bound"), F.col(value).alias("answer")))

    found = summaries.groupBy(*keys, "n").agg(F.count("*").alias("points"), F.array(*(nearest(i) for i in range(1, parts))).alias("_near"))
    each = found.select(*keys, "n", "points", F.posexplode("_near").alias("_i", "_x"))
    i = F.col("_i") + 1
    return each.select(*keys, i.cast("int").alias("i"), "n", F.floor((i * F.col("n") + (parts - 1)) / parts).cast("long").alias("target"), "points", F.col("_x.answer").alias("answer"), F.col("_x.bound").alias("bound"))


def batched(rows: DataFrame, batches: int) -> DataFrame:
    """(stream, grp, batch, x, rows) of (stream, grp, id, money, rows): x is money in hundredths plus 1000 for each batch.

    Rows without grp or with money null or not finite are dropped. A row without id is of the batch of
    an empty id. Money beyond the range of hundredths in a long is an error of the cast's kind (it saturates).
    """
    money = F.col("money").cast("double")
    batch = (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % batches).cast("int")
    finite = money.isNotNull() & ~F.isnan(money) & (F.abs(money) != float("inf"))
    return rows.where(F.col("grp").isNotNull() & finite).select(
        "stream", F.col("grp").cast("string").alias("grp"), batch.alias("batch"), (F.floor(100 * money + 0.5) + 1000 * batch).cast("long").alias("x"), "rows"
    )


def streams_of(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(stream, grp, id, money, rows): the values of clicks by client, and the prices of sold items by brand.

    ``rows`` says how many rows are alike: lines of one item and vendor are counted before they meet
    the item, so an item with a third of all lines sends few of them.

    A click_id counts once, by its least (client_id, value) if its rows differ; rows without one
    count each. Lines without an item are dropped; of an item's rows the least (brand, price) counts.
    """
    named = clicks.where("click_id is not null").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("_r")).select("click_id", "_r.client_id", "_r.value")
    once = named.unionByName(clicks.where("click_id is null").select("click_id", "client_id", "value"))
    value = once.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("value").alias("money"), F.lit(1).cast("long").alias("rows"))
    known = items.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("_r")).select("item_id", "_r.brand", "_r.price")
    lines = sale_lines.where("item_id is not null").groupBy("item_id", "vendor_id").agg(F.count("*").alias("rows"))
    price = lines.join(known, "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"), "rows")
    return value.unionByName(price)


def stream_quantiles(rows: DataFrame, batches: int = 4, points: int = POINTS, least: int = LEAST_POINTS, most: int = 1000, parts: int = 4, least_rows: int = 20, per_mille: int = 20) -> DataFrame:
    """Quantiles of every batch and of all batches of each (stream, grp), beside the exact ranks.

    ``rows`` are (stream, grp, batch, x, rows). Every batch of a group is summarised, and the whole (batch
    -1) is merged from these summaries alone. For summaries of at least ``least_rows`` rows the result
    has stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within
    and bound (what the summary itself promises of rank_error). Groups with fewer rows are summed all
    the same and give no row. An empty table gives an empty result; other columns are not read.
    """
    keys = ["stream", "grp", "batch"]
    counts = rows.groupBy(*keys, "x").agg(F.sum("rows").alias("_c"))
    whole = F.explode(F.array(F.col("batch"), F.lit(-1))).alias("batch")
    both = counts.select("stream", "grp", whole, "x", "_c").groupBy(*keys, "x").agg(F.sum("_c").alias("_c"))
    ranks = ranks_of_counts(both, keys, "x")
    single = scratch.table(summarise(ranks.where("batch >= 0"), keys, "x", points, least), "summaries")
    merged = merge(single, ["stream", "grp"], ["batch"], "x", most)
    summaries = single.unionByName(merged.withColumn("batch", F.lit(-1)))
    found = quantiles(summaries.where(F.col("n") >= least_rows), keys, "x", parts)
    # the ranks show what is exact: the value at each target, and how many lie below and up to each answer
    known = ranks.where(F.col("n") >= least_rows)
    target = F.floor((F.col("i") * F.col("n") + (parts - 1)) / parts)
    exact = (
        known.where(F.floor((F.col("upto") * parts) / F.col("n")) > F.floor((F.col("below") * parts) / F.col("n")))
        .select(*keys, F.col("x").alias("exact_x"), "below", "upto", "n", F.explode(F.array(*(F.lit(i) for i in range(1, parts)))).alias("i"))
        .where((F.col("below") < target) & (target <= F.col("upto")))
        .select(*keys, "i", "exact_x")
    )
    seen = known.select(*keys, F.col("x").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return (
        found.join(seen, [*keys, "answer"])
        .join(exact, [*keys, "i"])
        .withColumn("rank_error", error)
        .select(*keys, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (1000 * F.col("rank_error") <= per_mille * F.col("n")).alias("within"), "bound")
    )
