"""Percentiles, tie groups, and uncertainty by leaving units out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import ordered
from quillgraph.plans.lineage import cut
from quillgraph.schema import MOST_REPLICATES


def ranked(rows: DataFrame, value: str, node: str = "node", keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Ordinal ranks by falling value, ties by id."""
    if keys:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), node)))
    return ordered.numbered(rows, [F.desc(value), F.asc(node)], name)


def percentile(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the share of rows at or below the value; ties share it."""
    return ordered.with_share(rows, value, name)


def strict_percentile(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the share of rows strictly below the value."""
    return ordered.with_share(rows, value, name, strict=True)


def value_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """(value, percentile): the share of rows at or below each distinct value."""
    return ordered.counted(rows, value).select(value, (F.col("_upto") / F.col("_total")).alias("percentile"))


def tie_groups(rows: DataFrame, value: str, error: str, position: str, name: str = "tie_group") -> DataFrame:
    """Groups, from 0, of rows that are next to each other on display and too close to tell apart.

    A row starts a new group if it differs from the one before by more than half the sum of
    their errors, up or down.
    """


    def apart(here, before):
        return F.abs(here[value] - before[value]) > (here[error] + before[error]) / 2

    return ordered.runs(rows, position, [value, error], apart, name)


def tie_runs(rows: DataFrame, group: str, position: str) -> DataFrame:
    """(run, tie_group, size, first, last, label): contiguous rows of a group; ties share '=first'."""
    marked = ordered.runs(rows, position, [group], lambda here, before: ~here[group].eqNullSafe(before[group]) & before.isNotNull(), "_run")
    found = marked.groupBy("_run").agg(F.first(group).alias("tie_group"), F.count("*").alias("size"), F.min(position).alias("first"), F.max(position).alias("last"))
    label = F.concat(F.when(F.col("size") > 1, "=").otherwise(""), F.col("first").cast("string"))
    return found.select((F.col("_run") + 1).cast("int").alias("run"), "tie_group", "size", "first", "last", label.alias("label"))


def trust_units(trust: DataFrame, sources: DataFrame) -> DataFrame:
    """(work_id, strength, unit): seeds set by hand are units; all seeds of an upload are one.

    ``sources`` is (work_id, upload_id); a work of several uploads goes with the lowest.
    """
    lowest = sources.groupBy("work_id").agg(F.min("upload_id").alias("upload_id"))
    unit = F.coalesce(F.concat(F.lit("u:"), F.col("upload_id").cast("string")), F.concat(F.lit("w:"), "work_id"))
    return trust.join(lowest, "work_id", "left").select("work_id", "strength", unit.alias("unit"))


def replicates(units: DataFrame, most: int = MOST_REPLICATES) -> DataFrame:
    """(replicate, unit): the units left out, evenly spaced if there are more than ``most``."""
    one = Window.partitionBy(F.lit(1))
    n = units.select("unit").distinct().withColumn("i", F.row_number().over(one.orderBy("unit")) - 1).withColumn("n", F.count("*").over(one))
    take = F.expr(f"transform(sequence(0, {most - 1}), k -> least(cast(floor(k * n / {most}) as int), n - 1))")
    return n.where((F.col("n") <= most) | F.array_contains(take, F.col("i").cast("int"))).select((F.row_number().over(one.orderBy("i"))).alias("replicate"), "unit")


def jackknife(full: DataFrame, partial: DataFrame, n_units: int, n_replicates: int, missing=None, is_signed: bool = False) -> DataFrame:
    """``full`` (node, score) with stderr, ci_low and ci_high from ``partial`` (replicate, node, score).

    The error is the spread over the replicates times the root of units - 1; a replicate that did
    not reach a node counts as ``missing`` (0). One replicate gives half the score.
    """
    missing = F.lit(0.0) if missing is None else missing
    every = full.select("node", "score", missing.alias("missing"), F.explode(F.sequence(F.lit(1), F.lit(max(1, n_replicates)))).alias("replicate"))
    seen = every.join(partial.select("replicate", "node", F.col("score").alias("other")), ["replicate", "node"], "left")
    spread = F.stddev_pop(F.coalesce("other", "missing")) * F.sqrt(F.lit(float(max(1, n_units - 1))))
    found = seen.groupBy("node", "score").agg(spread.alias("spread"))
    error = F.col("spread") if n_replicates > 1 else 0.5 * F.abs("score")
    out = found.withColumn("stderr", error)
    low = F.col("score") - 1.96 * F.col("stderr")
    return out.select("node", "score", "stderr", (low if is_signed else F.greatest(F.lit(0.0), low)).alias("ci_low"), (F.col("score") + 1.96 * F.col("stderr")).alias("ci_high"))


def proportional(rows: DataFrame) -> DataFrame:
    """The band for scores without replicates: half the score either way, and marked as such."""
    half = 0.5 * F.abs("score")
    return rows.withColumns({"stderr": half, "ci_low": F.col("score") - half, "ci_high": F.col("score") + half, "method": F.lit("proportional")})


def bootstrap_mean(rows: DataFrame, value: str, order: str, n: int = 4000, seed: int = 11) -> DataFrame:
    """One row: mean and its 2.5 and 97.5 percentiles over resamples.

    A resample draws as many Poisson(1) weights as there are rows, in the task that holds them.
    """
    weights = F.expr(f"transform(sequence(1, {n}), i -> pmod(xxhash64({order}, i, {seed}), 1000000) / 1000000.0)")
    cut = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406]  # Poisson(1) up to 5
    count = " + ".join(f"if(u >= {c}, 1, 0)" for c in cut)
    drawn = rows.select(F.col(value).alias("v"), F.posexplode(weights).alias("replicate", "u")).withColumn("k", F.expr(count))
    means = drawn.groupBy("replicate").agg((F.sum(F.col("k") * F.col("v")) / F.greatest(F.sum("k"), F.lit(1))).alias("m"))
    spread = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(spread))  # one row each


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the correlation of average ranks."""
    both = ordered.with_average_rank(ordered.with_average_rank(rows.select(a, b), a, "_a"), b, "_b")
    return both.agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho"))


def inversions(values) -> int:
    """How many pairs of a sequence are in falling order; equal values are not."""
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(len(values))
    found, row = 0, rank
    # by the highest bit in which two ranks differ: rows are kept by the bits above, in their order
    for bit in range(max(0, len(values) - 1).bit_length() - 1, -1, -1):
        one, group = row >> bit & 1, row >> (bit + 1)
        ones = np.cumsum(one)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat((ones - one)[first], np.diff(np.append(first, len(row))))
        found += int((ones - before)[one == 0].sum())
        row = row[np.argsort(row >> bit, kind="stable")]
    return found


def _counted_inversions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row: ``n``, the inversions inside the groups of ``key``."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(group.sort_values(order)[value].to_numpy())]})

    return rows.select(key, order, value).groupBy(key).applyInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("n"))


def discordant(rows: DataFrame, a: str, b: str, block: int = 100_000, most_bands: int = 4096) -> DataFrame:
    """One row: ``n`` pairs of rows of which one is higher in a and the other in b.

    Rows are numbered by (a, b) and by (b, the first number), through ranges with offsets, so pairs that
    count are those that the second number puts the other way round. Blocks of the first number and
    bands of the second cut the rows into cells: pairs of different blocks and bands are counted from
    the cells' sizes, those of one block by the bands, and those of one band by the numbers.
    """
    first = ordered.numbered(rows.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.monotonically_increasing_id().alias("_i")), [F.col("_a"), F.col("_b"), F.col("_i")], "_x")
    both = cut(ordered.numbered(first.select("_b", F.col("_x").cast("long").alias("_x")), [F.col("_b"), F.col("_x")], "_y"), "numbers")
    n = both.count()
    bands = max(1, min(most_bands, -(-n // block)))
    placed = cut(both.select("_x", "_y", F.floor((F.col("_x") - 1) / block).alias("_block"), F.floor((F.col("_y") - 1) * bands / max(1, n)).alias("_band")), "cells")
    cells = placed.groupBy("_block", "_band").agg(F.count("*").alias("_c"))
    grid = placed.select("_block").distinct().withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).join(cells, ["_block", "_band"], "left").select("_block", "_band", F.coalesce("_c", F.lit(0)).alias("_c"))
    earlier = Window.partitionBy("_band").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("_block").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    above = grid.withColumn("_e", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).withColumn("_h", F.coalesce(F.sum("_e").over(higher), F.lit(0)))
    apart = above.agg(F.coalesce(F.sum(F.col("_c").cast("decimal(19,0)") * F.col("_h")), F.lit(0)).cast("decimal(38,0)").alias("n"))
    # of one block but different bands, and of one band whatever the block
    return apart.unionByName(_counted_inversions(placed, "_block", "_x", "_band")).unionByName(_counted_inversions(placed, "_band", "_x", "_y")).agg(F.sum("n").alias("n"))


def kendall(rows: DataFrame, a: str, b: str, block: int = 100_000) -> DataFrame:
    """One row: n, discordant pairs and tau-b; null where a side is all ties. Rows with a null take no part."""
    used = cut(rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "kendall")

    def tied(*by: str) -> DataFrame:
        c = F.col("c").cast("decimal(19,0)")
        return used.groupBy(*by).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0)).cast("double").alias("_".join(by)))

    n = used.agg(F.count("*").alias("n"))
    facts = n.crossJoin(tied("a")).crossJoin(tied("b")).crossJoin(tied("a", "b")).crossJoin(discordant(used, "a", "b", block).select(F.col("n").cast("double").alias("q")))  # one row each
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    spread = F.sqrt((pairs - F.col("a")) * (pairs - F.col("b")))
    agreed = pairs - F.col("a") - F.col("b") + F.col("a_b") - 2 * F.col("q")
    return facts.select("n", F.col("q").cast("long").alias("discordant"), F.when(spread > 0, agreed / spread).alias("tau"))
