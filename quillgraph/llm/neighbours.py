"""Approximate nearest neighbours by cross-polytope hashing with several probes and exact scores.

A vector is rotated by random signs and fast Hadamard transforms, three of each; its hash is the
signed axis that it then lies nearest to. A table joins ``functions`` such hashes to a cell. A query
probes in each table the cells that its own rotations make likeliest. Cells meet their queries in
blocks of bounded size, where all inner products are taken exactly; a query keeps its best ones.

Vectors differ in length, and the largest inner product is asked for, not the smallest angle: so
vectors are scaled by the largest length and get one more component that makes them unit vectors,
0 for queries. Angles then follow inner products.

How many cells a query probes is fitted: for a bounded sample of queries the true neighbours are found
over all rows, and the least number of probes is taken at which the tables would have found the target
share of them. With one function, all probes are the whole table, so the target can always be met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import scratch

TABLES, TARGET = 8, 0.96
#: A table has as many functions as leave about so many vectors to a cell.
CELL = 200
#: Queries whose true neighbours fit the number of probes.
SAMPLE = 128
#: Vectors of one block of a cell; longer cells are dealt over several.
BLOCK = 2048
#: Probes of a table that are put in order for a query.
MOST_PROBES = 1 << 14
_SEED = 0x5DEECE66D


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; rows are a power of two long."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """The rotations of all tables for vectors of one length; the same numbers on every machine."""

    def __init__(self, width: int, functions: int, tables: int = TABLES):
        self.width, self.functions, self.tables = width, functions, tables
        self.size = 1 << max(1, width.bit_length())  # at least width + 1
        self.axes = 2 * self.size
        draw = np.random.Generator(np.random.PCG64([_SEED, width]))
        self.signs = draw.choice(np.array([-1.0, 1.0]), size=(tables, functions, 3, self.size))

    def lifted(self, x: np.ndarray, longest: float) -> np.ndarray:
        """Unit vectors whose angles to queries follow the inner products."""
        out = np.zeros((len(x), self.size))
        out[:, : self.width] = x / longest
        out[:, self.width] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, : self.width] ** 2).sum(axis=1)))
        return out

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries as unit vectors."""
        out = np.zeros((len(x), self.size))
        top = np.abs(x).max(axis=1, keepdims=True)
        scaled = x / top
        out[:, : self.width] = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
        return out

    def rotated(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        for signs in self.signs[table, function]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for f in range(self.functions):
                out[:, t] = out[:, t] * self.axes + self.rotated(x, t, f).argmax(axis=1)
        return out

    def depth(self) -> int:
        """How many axes of each function take part in probes."""
        return min(self.axes, int(MOST_PROBES ** (1 / self.functions) + 1e-9))

    def probes(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` likeliest cells of each query, likeliest first."""
        cell = far = None
        for f in range(self.functions):
            v = self.rotated(x, table, f)
            axis = np.argsort(-v, axis=1, kind="stable")[:, : self.depth()]
            part = np.take_along_axis(v, axis, axis=1)
            part = (part[:, :1] - part) ** 2
            if cell is None:
                cell, far = axis, part
            else:
                cell = (cell[:, :, None] * self.axes + axis[:, None, :]).reshape(len(x), -1)
                far = (far[:, :, None] + part[:, None, :]).reshape(len(x), -1)
        order = np.argsort(far, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cell, order, axis=1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of each x with q, summed alike wherever a vector stands."""
    return (x * q).sum(axis=1)


class Best:
    """The k highest (score, smaller id first) of each query met so far in a task."""

    def __init__(self, k: int, most: int = 200_000):
        self.k, self.most, self.size = k, most, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            ids, scores = ids[keep], scores[keep]
        self.parts.append((np.full(len(ids), query, dtype=np.int64), ids, scores))
        self.size += len(ids)

    def full(self) -> bool:
        return self.size > self.most

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held, cut to k distinct ids a query; the store is empty then."""
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        fresh = np.ones(len(query), dtype=bool)
        fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])  # equal ids have equal scores, so they stand together
        query, ids, scores = query[fresh], ids[fresh], scores[fresh]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.k
        self.parts, self.size = [], 0
        return query[keep], ids[keep], scores[keep]

    def cut(self) -> None:
        self.parts = [self.taken()]
        self.size = len(self.parts[0][0])


def _batch(query, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, type=pa.int64()), pa.array(ids, type=pa.int64()), pa.array(scores, type=pa.float64())], names=["query", "rep", "score"])


FOUND = "query long, rep long, score double"


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(good)


def _true(classes: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, list[float]]]:
    """(query, place, vector) of the k best classes of a bounded list of queries, over all classes."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(queries)
    width = len(queries[0][1])

    def search(batches):
        best = Best(k)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _vectors(batch.column(1), width)
            for i, q in sent.value:
                best.add(i, ids, _scores(x, q))
            best.cut()
        yield _batch(*best.taken())

    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = classes.select("rep", "v").mapInArrow(search, FOUND).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return [(r.query, r.place, r.v) for r in found.join(classes.select("rep", "v"), "rep").select("query", "place", "v").collect()]


def fitted(classes: DataFrame, queries: list[tuple[int, np.ndarray]], n: int, longest: float, k: int, tables: int = TABLES, target: float = TARGET) -> tuple[Hasher, int]:
    """(hasher, probes): as many functions as leave CELL vectors to a cell, and the least number of probes
    in each table that finds ``target`` of the sample's true neighbours; fewer functions if none does."""
    width = len(queries[0][1])
    near = _true(classes, queries, k)
    by = {i: q for i, q in queries}
    functions = max(1, round(math.log(max(1.0, n / CELL)) / math.log(2 * (1 << max(1, width.bit_length())))))
    while True:
        hasher = Hasher(width, functions, tables)
        most = hasher.depth() ** functions
        first = np.full(len(near), most, dtype=np.int64)
        cells = hasher.cells(hasher.lifted(np.array([v for _, _, v in near], dtype=np.float64), longest))
        for i, q in by.items():
            mine = [j for j, r in enumerate(near) if r[0] == i]
            for t in range(tables):
                probes = hasher.probes(hasher.asked(q[None, :]), t, most)[0]
                place = np.full(len(mine), most, dtype=np.int64)
                row, at = np.nonzero(cells[mine, t][:, None] == probes[None, :])
                place[row] = at
                first[mine] = np.minimum(first[mine], place)
        need = int(np.quantile(first, target, method="higher")) + 1
        if need <= most:
            return hasher, need
        functions -= 1


def _search(classes: DataFrame, queries: DataFrame, hasher: Hasher, probes: int, longest: float, k: int) -> DataFrame:
    """(query, rep, score), written: the k best classes of each query among those in the cells that it probes."""
    width, tables = hasher.width, hasher.tables

    def index(batches):
        for batch in batches:
            cells = hasher.cells(hasher.lifted(_vectors(batch.column(1), width), longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells), type=pa.list_(pa.int64()))], names=["rep", "v", "cells"])

    def probing(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = hasher.asked(_vectors(part.column(1), width))
                cells = np.stack([hasher.probes(x, t, probes) for t in range(tables)], axis=1)
                flat = pa.array(list(cells.reshape(len(part), -1)), type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], names=["rep", "v", "cells"])

    def meet(batches):
        best, key, ids, x = Best(k), None, [], []
        held_ids = held = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:5]]
            vectors = _vectors(batch.column(5), width)
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(vectors)], strict=True):
                here = (columns[0][lo], columns[1][lo], columns[2][lo])
                if here != key:
                    key, ids, x, held = here, [], [], None
                if columns[3][lo] == 0:
                    ids.append(columns[4][lo:hi])
                    x.append(vectors[lo:hi])
                elif ids:
                    if held is None:
                        held_ids, held = np.concatenate(ids), np.concatenate(x)
                    for query, q in zip(columns[4][lo:hi], vectors[lo:hi], strict=True):
                        best.add(query, held_ids, _scores(held, q))
                        if best.full():
                            best.cut()
                            if best.size > best.most // 2:
                                yield _batch(*best.taken())
        yield _batch(*best.taken())

    shape = f"rep long, v {classes.schema['v'].dataType.simpleString()}, cells array<bigint>"
    hashed = scratch.table(classes.select("rep", "v").mapInArrow(index, shape), "hashed")
    each = hashed.select("rep", "v", F.posexplode("cells").alias("tbl", "cell"))
    # cells of more than a block are dealt over several, and their queries meet each of these
    large = each.groupBy("tbl", "cell").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    large = scratch.table(large.select("tbl", "cell", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")), "large")
    one = F.coalesce("blocks", F.lit(1))
    placed = each.join(large, ["tbl", "cell"], "left").select("tbl", "cell", F.pmod(F.xxhash64("rep"), one).cast("int").alias("block"), F.lit(0).alias("side"), "rep", "v")
    probed = queries.mapInArrow(probing, shape).select("rep", "v", F.posexplode("cells").alias("_at", "cell")).withColumn("tbl", F.floor(F.col("_at") / probes).cast("int"))
    probed = probed.join(large, ["tbl", "cell"], "left").select("tbl", "cell", F.explode(F.sequence(F.lit(0), one - 1)).alias("block"), F.lit(1).alias("side"), "rep", "v")
    together = placed.unionByName(probed).repartition("tbl", "cell", "block").sortWithinPartitions("tbl", "cell", "block", "side")
    found = together.mapInArrow(meet, FOUND).repartition("query").distinct()
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return scratch.table(found.withColumn("_place", F.row_number().over(top)).where(F.col("_place") <= k).drop("_place"), "found")


def _of_width(rows: DataFrame, is_query, k: int, tables: int, target: float, width: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of at most the k best found rows of each query, for vectors of one length."""
    spark = rows.sparkSession
    # equal vectors are one class with its k + 1 smallest ids; more can't come to a result
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    classes = scratch.table(first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = scratch.table(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).join(classes.select("v", "rep"), "v").select("vec_id", "rep"), "asked")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = classes.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.sum(F.size("ids")).alias("members")).first()
    queries = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    sample = [(r.rep, np.array(r.v, dtype=np.float64)) for r in queries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hasher, probes = fitted(classes, sample, facts.n, facts.longest, k + 1, tables, target)
    found = _search(classes, queries, hasher, probes, facts.longest, k + 1)
    # a query that met too few goes through all cells of one table
    members = classes.select("rep", F.size("ids").alias("_m"))
    enough = found.join(members, "rep").groupBy("query").agg(F.sum("_m").alias("_m")).where(F.col("_m") >= min(k + 1, facts.members))
    short = scratch.table(queries.join(enough.select(F.col("query").alias("rep")), "rep", "left_anti"), "short")
    if not short.isEmpty():
        whole = Hasher(width, 1, 1)
        again = _search(classes, short, whole, whole.axes, facts.longest, k + 1)
        found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(again)
    # classes become rows again: k + 1 for each distinct query, one of which may be the query itself
    listed = found.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    placed = listed.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_place") <= k + 1)
    lists = placed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    joined = asked.join(lists, asked.rep == lists["query"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b.vec_id != F.col("vec_id")), 1, k).alias("best"))
    return joined.select("query_id", F.posexplode("best").alias("_at", "b")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows of the largest inner products found for each query row.

    ``is_query`` is a column condition on vec_id. Candidates are all rows but those with the query's own
    id; equal scores go to the smaller vec_id. Scores are inner products of the vectors as given, in
    double precision. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, take no part; vectors of different lengths do not meet. Rows that repeat a vec_id
    each count as a candidate; as a query the id counts once, with its least vector. Every row is in the
    index; ``target`` is the share of the true neighbours that the number of probes is fitted to on
    SAMPLE queries, against all rows. A query
    that met fewer than k goes through all cells, so only a lack of candidates leaves it with fewer rows. An empty table gives an
    empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch.ship(spark)
    rows = scratch.table(_usable(vectors), "vectors")
    widths = [r.w for r in rows.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]
    found = None
    for width in widths:  # usually one
        part = _of_width(rows.where(F.size("v") == width), is_query, k, tables, target, width)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
