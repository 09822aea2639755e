"""The most similar title of each query, in blocks of queries and titles.

A block of titles is an inverted index of their trigrams, and all queries of a block look up theirs
at once. What a query must share follows from the best title that is known for it so far, so that a few of
its rarest trigrams lead to all titles that could be as good; of several looked up, a title has to be
met more than once. No row is made for a pair of a query and a title. Functions in tasks are nested, so
executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles and queries of a block.
TITLES, QUERIES = 1 << 17, 50_000
#: Postings that are gathered at once, and pairs that are compared at once.
GATHERED, COMPARED = 1 << 22, 1 << 19
#: Bytes of the table of a block's queries by trigrams.
TABLE = 1 << 26


def _matcher(threshold: float, years: bool, gathered: int, compared: int, table_bytes: int):
    """(query, id, similarity): the best title of a block for each query that has one as good as it asks for, ties by id."""

    def match(queries, titles):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def whole(column):
            column = column.combine_chunks()
            return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)

        def result(q, t, s):
            return pa.table({"query": whole(queries["query"]).take(pa.array(q, pa.int64())), "id": whole(titles["id"]).take(pa.array(t, pa.int64())), "similarity": pa.array(s, pa.float64())})

        def ranges(lo, n):
            """The numbers of all ranges from ``lo`` on, ``n`` of each."""
            return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())

        nothing = np.empty(0, np.int64)
        if not len(queries) or not len(titles):
            return result(nothing, nothing, np.empty(0))
        ids, lists = whole(titles["id"]), whole(titles["grams"])
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        coded = lists.flatten().dictionary_encode()
        code, m = coded.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin, of = np.cumsum(m) - m, np.repeat(np.arange(len(m)), m)
        first, span = 0, 1
        key = code
        if years:
            year = whole(titles["year"]).to_numpy().astype(np.int64)
            first, span = year.min(), year.max() - year.min() + 1
            key = code * span + (year - first)[of]
        order = np.argsort(key, kind="stable")
        key, posting = key[order], of[order]

        asked = whole(queries["grams"])
        found = pc.index_in(asked.flatten(), value_set=coded.dictionary).fill_null(-1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False))
        n, least = whole(queries["n"]).to_numpy().astype(np.int64), np.maximum(whole(queries["least"]).to_numpy(), threshold)
        owner, found = owner[found >= 0], found[found >= 0]
        low, high = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        if years:
            about = (whole(queries["year"]).to_numpy().astype(np.int64) - first)[owner]
            low, high = np.clip(about - 1, 0, span), np.clip(about + 1, -1, span - 1)
        lo = np.searchsorted(key, found * span + low, "left")
        df = np.maximum(np.searchsorted(key, found * span + high, "right") - lo, 0)
        known = df > 0
        owner, found, lo, df = owner[known], found[known], lo[known], df[known]
        order = np.lexsort((df, owner))  # a query's rarest trigrams first
        owner, found, lo, df = owner[order], found[order], lo[order], df[order]
        met = np.bincount(owner, minlength=len(n))
        start = np.cumsum(met) - met
        place = np.arange(len(owner)) - start[owner]
        upto = np.concatenate([[0], np.cumsum(df)])

        # a title at ``least`` shares ``needed`` of the trigrams met here, so ``times`` of any met - needed + times of them
        needed = np.maximum(1, np.ceil(least * n - 1e-9).astype(np.int64))
        live = met >= needed
        times, looked = np.ones(len(n), np.int64), np.where(live, met - needed + 1, 0)
        cost = upto[start + looked] - upto[start]
        base = cost.copy()
        for more in (2, 3):
            longer = np.where(live & (needed >= more), met - needed + more, looked)
            dearer = upto[start + longer] - upto[start]
            better = live & (needed >= more) & (dearer <= 2 * base) & (times == more - 1)
            times, looked, cost = np.where(better, more, times), np.where(better, longer, looked), np.where(better, dearer, cost)
        longest = met * (1 + 1 / least) - n + 1e-9

        rows = max(1, table_bytes // len(coded.dictionary))
        some = np.flatnonzero(live)
        out = []
        at = 0
        while at < len(some):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(cost[some[at : at + rows]]), gathered, "right")) + at)
            stop = min(stop, at + rows, len(some))
            mine = some[at:stop]
            at = stop
            entry = ranges(start[mine], looked[mine])
            t, q = posting[ranges(lo[entry], df[entry])], np.repeat(np.searchsorted(mine, owner[entry]), df[entry])
            fits = (m[t] >= (least * n - 1e-9)[mine][q]) & (m[t] <= longest[mine][q])
            pair = np.sort(q[fits] * len(m) + t[fits])
            if not len(pair):
                continue
            heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            counts = np.diff(np.concatenate([heads, [len(pair)]]))
            pair = pair[heads]
            pair = pair[counts >= times[mine][pair // len(m)]]
            has = np.zeros((len(mine), len(coded.dictionary)), bool)
            every = ranges(start[mine], met[mine])
            has[np.searchsorted(mine, owner[every]), found[every]] = True
            for a in range(0, len(pair), compared):
                q, t = np.divmod(pair[a : a + compared], len(m))
                shared = np.add.reduceat(has[np.repeat(q, m[t]), code[ranges(begin[t], m[t])]].astype(np.int64), np.cumsum(m[t]) - m[t])
                s = shared / (n[mine][q] + m[t] - shared)
                good = s >= least[mine][q]
                out.append((mine[q[good]], t[good], s[good]))
        if not out:
            return result(nothing, nothing, np.empty(0))
        q, t, s = (np.concatenate(part) for part in zip(*out))
        order = np.lexsort((rank[t], -s, q))
        q, t, s = q[order], t[order], s[order]
        best = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else nothing
        return result(q[best], t[best], s[best])

    return match


def best(queries: DataFrame, titles: DataFrame, threshold: float, years: bool = False, n_titles: int = TITLES, n_queries: int = QUERIES, gathered: int = GATHERED, compared: int = COMPARED, table: int = TABLE) -> DataFrame:
    """(query, id, similarity): each query's most similar title at ``threshold`` or more, ties by id.

    ``queries`` is (query, grams, least[, year]) of distinct queries, ``titles`` (id, grams[, year]), both written
    tables without empty grams; with ``years`` both must be within one year, and rows without one match nothing.
    ``least`` is the similarity of some title that is known to a query, 0 if none is: nothing below it is looked for.
    """
    spark = queries.sparkSession
    if years:
        queries, titles = queries.where("year is not null"), titles.where("year is not null")
    of_titles = max(1, -(-titles.count() // n_titles))
    of_queries = max(1, -(-queries.count() // n_queries), -(-2 * spark.sparkContext.defaultParallelism // of_titles))
    # each block of queries meets each block of titles
    number = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")
    year = [F.col("year").cast("int").alias("year")] if years else []
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select("query", "grams", F.size("grams").alias("n"), F.col("least").cast("double").alias("least"), *year, (number("query", of_queries) * of_titles).alias("_b"), every(of_titles).alias("_o"))
    right = titles.select("id", "grams", *year, number("id", of_titles).alias("_b"), every(of_queries).alias("_o"))
    left = left.withColumn("cell", F.col("_b") + F.col("_o")).drop("_b", "_o").repartition(of_titles * of_queries, "cell")
    right = right.withColumn("cell", F.col("_o") * of_titles + F.col("_b")).drop("_b", "_o").repartition(of_titles * of_queries, "cell")
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {titles.schema['id'].dataType.simpleString()}, similarity double"
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_matcher(threshold, years, gathered, compared, table), schema)
    top = F.min(F.struct((-F.col("similarity")).alias("_s"), "id")).alias("_top")
    return found.groupBy("query").agg(top).select("query", F.col("_top.id").alias("id"), (-F.col("_top._s")).alias("similarity"))
