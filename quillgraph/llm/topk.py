"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are indexed in blocks; a block holds, for each dimension, its members sorted by that
component. A query walks its lists in parallel, largest contribution first, scores whatever it
meets in full, and stops when the sum of the contributions at the present depth, which bounds
all vectors not yet met, cannot beat its k-th best. The k-th best is carried from block to block
within a task, so most of the later blocks stop early or at once.

Queries are a stated set, taken in blocks of bounded size; each block of queries is one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import scratch

BLOCK = 4096
QUERY_BLOCK = 4096


class Index:
    """One block of integer vectors of equal length with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best`` is a list of (-score, id), ascending, of k at most; returned with this block's."""
        n = len(self.ids)
        live = np.flatnonzero(q)
        weight = q[live]
        up = weight > 0
        seen = np.zeros(n, dtype=bool)
        depth, step = 0, max(16, 2 * k)
        while depth < n:
            # the largest contributions at this depth: from the end of a list if the weight is positive
            at = np.where(up, n - 1 - depth, depth)
            bound = int((self.sorted[at, live] * weight).sum())
            if len(best) == k and -best[-1][0] > bound:
                break
            to = min(n, depth + step)
            if len(live):
                rows = np.arange(depth, to)
                met = self.order[np.where(up, n - 1 - rows[:, None], rows[:, None]), live].ravel()
                fresh = np.zeros(n, dtype=bool)
                fresh[met] = True
                fresh &= ~seen
            else:
                fresh, to = ~seen, n
            seen |= fresh
            new = np.flatnonzero(fresh & (self.ids != query_id))
            if len(new):
                scores = self.vectors[new] @ q
                if len(best) == k:
                    keep = scores >= -best[-1][0]
                    new, scores = new[keep], scores[keep]
                elif len(new) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    new, scores = new[scores >= least], scores[scores >= least]
                pool = best + [(-int(s), int(i)) for s, i in zip(scores.tolist(), self.ids[new].tolist(), strict=True)]
                best = sorted(pool)[:k]
            if seen.all():
                break
            depth, step = to, 2 * step
        return best


def quantised(column, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for null vectors and those with null or non-finite parts."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.floor(np.asarray(v, dtype=np.float64) * scale)
        out.append(x if np.isfinite(np.asarray(v, dtype=np.float64)).all() else None)
    return out


def _exact(*arrays: np.ndarray) -> type:
    """The cheapest number type in which inner products of such rows are exact."""
    top = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    width = max((a.shape[1] for a in arrays), default=1)
    if top * top * width < 2**53:
        return np.float64
    return np.int64 if top * top * width < 2**62 else object


def _stacked(rows: list[np.ndarray], kind: type) -> np.ndarray:
    if kind is object:
        return np.array([[int(x) for x in r] for r in rows], dtype=object)
    return np.stack(rows).astype(kind)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    ``is_query`` is a column condition on vec_id. Candidates are all rows but those with the
    query's own id; equal scores go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part; vectors of different lengths do
    not meet. An empty table gives an empty result. Rows that repeat a vec_id each count as a
    candidate; as a query the id counts once, with its least vector. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch.ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    schema = "query_id long, vec_id long, score long"
    found = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).select("vec_id", "embedding")
        table = part.toArrow()  # about QUERY_BLOCK vectors
        queries = [(i, q) for i, q in zip(table.column(0).to_pylist(), quantised(table.column(1), scale), strict=True) if q is not None]
        sent = spark.sparkContext.broadcast(queries)

        def search(batches, sent=sent):
            best: dict[int, list[tuple[int, int]]] = {}
            held: dict[int, list[tuple[int, np.ndarray]]] = {}

            def flush(width: int) -> None:
                block = held.pop(width)
                mine = [(i, q) for i, q in sent.value if len(q) == width]
                if not mine:
                    return
                plain = [v for _, v in block]
                kind = _exact(np.stack(plain + [q for _, q in mine]))
                index = Index(np.array([i for i, _ in block], dtype=np.int64), _stacked(plain, kind))
                for (i, _), q in zip(mine, _stacked([q for _, q in mine], kind), strict=True):
                    best[i] = index.search(i, q, k, best.get(i, []))

            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), quantised(batch.column(1), scale), strict=True):
                    if v is not None:
                        held.setdefault(len(v), []).append((i, v))
                        if len(held[len(v)]) >= BLOCK:
                            flush(len(v))
            for width in list(held):
                flush(width)
            out = [(i, j, -s) for i, pool in best.items() for s, j in pool]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

        hits = rows.mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
