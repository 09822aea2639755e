"""Rankings and what is read off them: recommendations, blind spots, diversity, simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import graph, resample, score, views
from quillgraph.plans.lineage import buckets, cut, is_dealt
from quillgraph.schema import COLD_START, DISCLAIMER, DISTRUST, LIFT_GAMMA, MOST_POOL, MOST_REPLICATES, STRENGTHS


def seed_weights(trust: DataFrame) -> DataFrame:
    """(node, weight) of a trust list: by strength, or the distrust weight."""
    by = F.create_map(*[x for k, w in STRENGTHS.items() for x in (F.lit(k), F.lit(w))])
    return trust.select(F.col("work_id").alias("node"), F.when(F.col("is_distrust"), F.lit(DISTRUST)).otherwise(by[F.col("strength")]).alias("weight"))


def trust_signature(trust: DataFrame) -> DataFrame:
    """One row: the first 16 digits of the SHA-1 of all id:strength:flag entries in order."""
    entry = F.concat_ws(":", "work_id", F.col("strength").cast("string"), F.col("is_distrust").cast("int").cast("string"))
    return trust.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(entry)), ",")), 1, 16).alias("signature"))


def visible(nodes: DataFrame, works: DataFrame, trust: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Papers that may be shown: full works, not trusted or distrusted, not others' hidden uploads."""
    shown = nodes.join(works.where(~F.col("is_stub")).select(F.col("id").alias("node")), "node", "left_semi")
    shown = shown.join(trust.select(F.col("work_id").alias("node")), "node", "left_anti")
    return shown.join(hidden.select(F.col("work_id").alias("node")), "node", "left_anti") if hidden is not None else shown


def composed(edges: DataFrame, seeds: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, score): signed scores in every context of some weight, composed."""
    some = {r.context for r in weights.where("weight > 0").collect()}  # a row for each context
    used = tuple(c for c in views.CONTEXTS if c in some)
    if not used:
        return seeds.select(*keys, "node", F.lit(0.0).alias("score")).limit(0)
    parts = buckets(edges) if is_dealt(edges, ["src"]) else max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // graph.PART)
    found = views.keyed(views.transition(edges, parts), seeds, keys, used)
    return score.compose(found.withColumnRenamed("view", "context"), weights, keys)


def rank_profile(edges: DataFrame, works: DataFrame, trust: DataFrame, sources: DataFrame, weights: DataFrame, hidden: DataFrame | None = None, most: int = MOST_REPLICATES) -> DataFrame:
    """(rank, node, score, stderr, ci_low, ci_high, tie_group, reliable) of all visible papers.

    The full trust list is replicate 0; each further one leaves a unit out, distrust always
    staying. All replicates and contexts are scored in one plan.
    """
    units = cut(resample.trust_units(trust.where(~F.col("is_distrust")), sources), "units")
    left_out = cut(resample.replicates(units, most), "replicates")
    n_units = units.select("unit").distinct().count()
    n_replicates = left_out.count() if n_units > 1 else 0
    seeds = seed_weights(trust).join(units.select(F.col("work_id").alias("node"), "unit"), "node", "left")
    runs = seeds.withColumn("replicate", F.lit(0))
    if n_replicates:
        one_less = seeds.crossJoin(F.broadcast(left_out.withColumnRenamed("unit", "gone"))).where("unit is null or unit != gone")
        runs = runs.unionByName(one_less.select(*seeds.columns, "replicate"))
    scores = cut(composed(edges, runs.select("replicate", "node", "weight"), weights, ["replicate"]), "scores")
    full = visible(scores.where("replicate = 0").select("node", "score"), works, trust, hidden)
    if n_replicates:
        banded = resample.jackknife(full, scores.where("replicate > 0"), n_units, n_replicates)
    else:
        banded = resample.proportional(full).drop("method")
    out = resample.tie_groups(resample.ranked(banded, "score"), "score", "stderr", "rank")
    return out.withColumns({"reliable": F.lit(n_units >= COLD_START), "disclaimer": F.lit(DISCLAIMER)})


def lift_rank(ranking: DataFrame, back: DataFrame, gamma: float = LIFT_GAMMA) -> DataFrame:
    """``ranking`` (node, score) by lift over the background, ranks anew."""
    joined = ranking.join(back.select("node", F.col("score").alias("back")), "node", "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    return resample.ranked(joined.withColumn("lift", score.lift(F.col("score"), F.col("back"), gamma)), "lift")


def pool(ranking: DataFrame, merit: DataFrame, most: int = MOST_POOL) -> DataFrame:
    """(rank, node, score, trust_pct, merit, global_pct): the first ``most`` of a ranking.

    Both percentiles are among the pool; merit is 0 where ``merit`` has no score.
    """
    top = page(resample.ranked(ranking.select("node", "score"), "score"), 0, most)
    top = top.join(merit.select("node", F.col("score").alias("merit")), "node", "left").withColumn("merit", F.coalesce("merit", F.lit(0.0)))
    out = resample.percentile(resample.percentile(top, "score", "trust_pct"), "merit", "global_pct")
    return out.select("rank", "node", "score", "trust_pct", "merit", "global_pct")


def lift_profile(scores: DataFrame, back: DataFrame, shown: DataFrame, n_units: int, n_replicates: int, gamma: float = LIFT_GAMMA) -> DataFrame:
    """(rank, node, lift, stderr, ci_low, ci_high, tie_group) of the nodes of ``shown``, by lift.

    ``scores`` is (replicate, node, score), 0 being the full list. Only the scores vary: the
    background is one for all readers. A replicate that did not reach a node counts as lift 0, and
    bands may go below 0. Ties are those of this order.
    """
    both = scores.join(back.select("node", F.col("score").alias("back")), "node", "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    lifts = cut(both.select("replicate", "node", score.lift(F.col("score"), F.col("back"), gamma).alias("score")), "lifts")
    full = lifts.where("replicate = 0").join(shown.select("node"), "node", "left_semi").select("node", "score")
    banded = resample.jackknife(full, lifts.where("replicate > 0"), n_units, n_replicates, is_signed=True)
    banded = banded.select("node", *[F.round(c, 6).alias(n) for c, n in (("score", "lift"), ("stderr", "stderr"), ("ci_low", "ci_low"), ("ci_high", "ci_high"))])
    return resample.tie_groups(resample.ranked(banded, "lift"), "lift", "stderr", "rank")


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Ranks offset+1 to offset+limit; the numbers stay absolute."""
    return rows.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def year_filter(rows: DataFrame, works: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of works in a range of years, either end open; works without a year go if there is a range."""
    if first is None and last is None:
        return rows
    kept = works
    if first is not None:
        kept = kept.where(F.col("year") >= first)
    if last is not None:
        kept = kept.where(F.col("year") <= last)
    return rows.join(kept.select(F.col("id").alias("node")), "node", "left_semi")


def recommendations(ranking: DataFrame, merit: DataFrame, distance: DataFrame, dial: float, limit: int = 25) -> DataFrame:
    """(rank, node, blend, trust_pct, global_pct, novelty): from close (dial 0) to new (dial 1)."""
    if not 0 <= dial <= 1:
        raise ValueError("the dial goes from 0 to 1")
    pool = ranking.join(merit.select("node", F.col("score").alias("merit")), "node", "left").withColumn("merit", F.coalesce("merit", F.lit(0.0)))
    pool = pool.join(distance.select("node", "distance"), "node", "left")
    pool = resample.percentile(resample.percentile(pool, "score", "trust_pct"), "merit", "global_pct").withColumn("novelty", novelty(F.col("distance")))
    blend = (1 - dial) * F.col("trust_pct") + dial * F.col("global_pct") * F.col("novelty")
    out = resample.ranked(pool.withColumn("blend", F.round(blend, 9)), "blend")
    return out.where(F.col("rank") <= limit).select("rank", "node", "blend", "trust_pct", "global_pct", "novelty")


def novelty(distance):
    """0 in the trust list to 1 at four hops or out of reach."""
    return F.coalesce(F.least(distance, F.lit(4)) / 4.0, F.lit(1.0))


def blindspots(ranking: DataFrame, merit: DataFrame, works: DataFrame, trust: DataFrame, limit: int = 25) -> DataFrame:
    """(rank, node, gap, global_pct, trust_pct): good papers that the trust list hardly reaches.

    global_pct is among all of ``merit``, trust_pct among the ranking (0 if absent).
    """
    mine = resample.percentile(ranking.select("node", "score"), "score", "trust_pct").drop("score")
    every = resample.percentile(merit.select("node", "score"), "score", "global_pct").drop("score")
    gaps = visible(every, works, trust).join(mine, "node", "left").withColumn("trust_pct", F.coalesce("trust_pct", F.lit(0.0)))
    gaps = gaps.withColumn("gap", F.round(F.col("global_pct") - F.col("trust_pct"), 9)).where("gap > 0")
    return resample.ranked(gaps, "gap").where(F.col("rank") <= limit).select("rank", "node", "gap", "global_pct", "trust_pct")


def entropy(rows: DataFrame, dimension: str, category: str, sizes: DataFrame | None = None) -> DataFrame:
    """(dimension, n_obs, n_categories, entropy, most, normalised) of (dimension, category) observations.

    most is the entropy of as many observations spread over as many categories as there are in
    all (``sizes``: dimension, categories), or as were seen.
    """
    counts = rows.groupBy(dimension, category).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(dimension))
    shares = counts.withColumn("share", F.col("n") / total)
    found = shares.groupBy(dimension).agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_categories"), (-F.sum(F.col("share") * F.log("share"))).alias("entropy"))
    if sizes is not None:
        found = found.join(F.broadcast(sizes), dimension).drop("n_categories").withColumnRenamed("categories", "n_categories")
    width = F.least(F.greatest("n_obs", F.lit(1)), F.greatest("n_categories", F.lit(1)))
    found = found.withColumn("most", F.when(width > 1, F.log(width)).otherwise(0.0))
    return found.select(dimension, "n_obs", "n_categories", F.round("entropy", 9).alias("entropy"), F.round("most", 9).alias("most"), F.round(F.when(F.col("most") > 0, F.col("entropy") / F.col("most")).otherwise(0.0), 9).alias("normalised"))


def echo(entropies: DataFrame) -> DataFrame:
    """One row: mean normalised entropy over dimensions with data, 1 minus it, and a word for it."""
    out = entropies.where("n_obs > 0").agg(F.round(F.avg("normalised"), 9).alias("diversity"))
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("diversity")))
    return out.withColumn("echo", F.round(e, 9)).withColumn("band", F.when(F.col("echo") >= 0.7, "narrow").when(F.col("echo") >= 0.4, "mixed").otherwise("broad"))


def concentration(rows: DataFrame, dimension: str, category: str, each: int = 4, most: int = 8) -> DataFrame:
    """The largest shares: ``each`` of every dimension, then ``most`` in all."""
    counts = rows.groupBy(dimension, category).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(dimension)), 9))
    w = Window.partitionBy(dimension).orderBy(F.desc("share"), category)
    top = shares.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each)
    return top.orderBy(F.desc("share"), dimension, category).limit(most).select(dimension, category, "n", "share", "place")


def moves(before: DataFrame, after: DataFrame, limit: int = 100, beyond_both: bool = False) -> DataFrame:
    """(node, rank_before, rank_after, delta_rank, delta_score): the largest moves, up being positive.

    Both are (node, rank, score) and full rankings. A node missing on one side stands just past
    that side's end, or with ``beyond_both`` just past the ends of both laid end to end.
    """
    ends = before.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("end_before")).crossJoin(F.broadcast(after.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("end_after"))))  # one row each
    a = before.select("node", F.col("rank").alias("rank_before"), F.col("score").alias("score_before"))
    b = after.select("node", F.col("rank").alias("rank_after"), F.col("score").alias("score_after"))
    both = a.join(b, "node", "full").crossJoin(F.broadcast(ends))
    past_before, past_after = (F.col(x) + 1 for x in ("end_before", "end_after"))
    if beyond_both:
        past_before = past_after = F.col("end_before") + F.col("end_after") + 1
    was, now = F.coalesce("rank_before", past_before), F.coalesce("rank_after", past_after)
    change = F.coalesce("score_after", F.lit(0.0)) - F.coalesce("score_before", F.lit(0.0))
    out = both.select("node", was.alias("rank_before"), now.alias("rank_after"), (was - now).alias("delta_rank"), F.round(change, 9).alias("delta_score")).where("delta_rank != 0 or delta_score != 0")
    return out.orderBy(F.desc(F.abs("delta_rank")), F.desc(F.abs("delta_score")), "node").limit(limit)


def top_churn(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """(node, change): entered or left the top k."""
    a, b = (x.where(F.col("rank") <= k).select("node") for x in (before, after))
    return b.join(a, "node", "left_anti").withColumn("change", F.lit("entered")).unionByName(a.join(b, "node", "left_anti").withColumn("change", F.lit("left")))


def global_seeds(works: DataFrame, n: int = 200) -> DataFrame:
    """(node, weight): the most cited full works, evenly."""
    return works.where(~F.col("is_stub")).orderBy(F.desc("in_corpus_cited_by"), "id").limit(n).select(F.col("id").alias("node"), F.lit(1.0).alias("weight"))


def briefs(nodes: DataFrame, works: DataFrame, authors: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """(node, title, year, venue, authors): up to ``most`` authors in order; unknown ids come without the rest."""
    named = authors.join(names.withColumnRenamed("id", "author_id"), "author_id", "left")
    lists = named.join(nodes.select(F.col("node").alias("work_id")), "work_id", "left_semi").groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "author_id", F.coalesce("display_name", "author_id").alias("name")))).alias("people"))
    people = F.concat_ws(", ", F.transform(F.slice("people", 1, most), lambda x: x["name"]))
    out = nodes.select("node").join(works.withColumnRenamed("id", "node"), "node", "left").join(lists.withColumnRenamed("work_id", "node"), "node", "left")
    out = out.join(names.select(F.col("id").alias("venue_id"), F.col("display_name").alias("venue")), "venue_id", "left")
    return out.select("node", F.coalesce("title", "node").alias("title"), "year", "venue", F.coalesce(people, F.lit("")).alias("authors"))
