"""Substring dedup by difference-cover anchors.

A window is ``n`` consecutive words of one document. It is repeated if the same words also start
in a document with a smaller id; the words that repeated windows cover are removed.

Anchors are runs of ``n - v + 1`` words that start at a position whose index modulo the period
``v`` lies in a difference cover of ``v``. For any two positions there is a shift below ``v``
that brings both onto the cover, so two equal windows hold the same anchor at the same place,
wherever they stand. Only 3 of 7 positions are hashed for the default of 13 words. Anchors that
two documents share are found by the packed exchange (:mod:`chunks`); then each is extended:
the windows around shared anchors, and no others, are compared in full, each bucket of windows
finding the smallest document of each. Neither step makes pairs.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch
from quillgraph.llm.chunks import NO_ID, U64, Chunk, bucket_of, buckets_for, chunked, exchange, windows, with_answers

# Perfect difference covers by their period.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}


def cover_for(n: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves anchors of half a window at least."""
    v = max(p for p in COVERS if p <= max(1, (n + 1) // 2))
    return v, np.array(COVERS[v])


def cuts(buckets: np.ndarray):
    """(bucket, from, to) of the runs of an ascending array."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(buckets)], strict=True):
        if hi > lo:
            yield int(buckets[lo]), lo, hi


class Anchors:
    """The distinct anchors of a chunk, by hash, and where each of its words has one."""

    def __init__(self, chunk: Chunk, n: int):
        v, cover = cover_for(n)
        self.n, self.v = n, v
        self.words, self.docs = chunk.words()
        hashes, whole = windows(self.words, self.docs, n - v + 1)
        on = np.zeros(v, dtype=bool)
        on[cover] = True
        self.at = np.flatnonzero(whole & np.resize(on, len(whole)))
        values = hashes[self.at]
        order = np.argsort(values)
        values = values[order]
        first = np.ones(len(values), dtype=bool)
        first[1:] = values[1:] != values[:-1]
        self.unique = values[first]
        self.entry = np.empty(len(values), dtype=np.int64)
        self.entry[order] = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        docs = self.docs[self.at][order]
        self.here = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.zeros(0, dtype=bool)

    def candidates(self, n_buckets: int, answers: dict) -> np.ndarray:
        """Starts of the windows that hold an anchor which some other document has."""
        shared = self.here.copy()
        for b, lo, hi in cuts(bucket_of(self.unique, n_buckets)):
            if b in answers:
                shared[lo:hi] |= np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=hi - lo).astype(bool)
        m = len(self.words) - self.n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64)
        marks = np.zeros(len(self.words) + 1, dtype=np.int32)
        marks[self.at[shared[self.entry]] + 1] = 1
        sums = np.cumsum(marks)
        i = np.arange(m)
        return np.flatnonzero((sums[i + self.v] > sums[i]) & (self.docs[:m] == self.docs[self.n - 1 :]))


def distinct_windows(a: Anchors, chunk: Chunk, starts: np.ndarray):
    """(hash, second hash, smallest id) of the distinct windows at ``starts``, and each start's entry."""
    one, two = (windows(a.words, a.docs, a.n, seed)[0][starts] for seed in (0, 1))
    order = np.lexsort((two, one))
    one, two, ids = one[order], two[order], chunk.ids[a.docs[starts]][order]
    first = np.ones(len(one), dtype=bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    heads = np.flatnonzero(first)
    entry = np.empty(len(one), dtype=np.int64)
    entry[order] = np.cumsum(first) - 1
    return one[heads], two[heads], np.minimum.reduceat(ids, heads) if len(heads) else ids, entry


def _shared(parts: list[bytes], width: int) -> list[bytes | None]:
    """Which fingerprints of each part another part also has, as packed bits."""
    kind = np.dtype(f"u{width}")
    arrays = [np.frombuffer(p, dtype=kind) for p in parts]
    everything = np.sort(np.concatenate(arrays))
    twice = everything[1:][everything[1:] == everything[:-1]]
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
    out = []
    for a in arrays:
        hit = np.zeros(len(a), dtype=bool)
        if len(twice):
            k = np.searchsorted(twice, a)
            hit = twice[np.minimum(k, len(twice) - 1)] == a
        out.append(np.packbits(hit).tobytes() if hit.any() else None)
    return out


#: A window as it is sent: two hashes of 64 bits and the smallest id in its chunk.
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("id", "<i8")])


def _smallest(parts: list[bytes]) -> list[bytes | None]:
    """Where a window also stands in a document with a smaller id than the smallest of this part."""
    arrays = [np.frombuffer(p, dtype=WINDOW) for p in parts]
    rows = np.concatenate(arrays)
    order = np.lexsort((rows["two"], rows["one"]))
    key = rows[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key["one"][1:] != key["one"][:-1]) | (key["two"][1:] != key["two"][:-1])
    low = np.minimum.reduceat(key["id"], np.flatnonzero(first))
    smaller = np.empty(len(rows), dtype=bool)
    smaller[order] = low[np.cumsum(first) - 1] < key["id"]
    ends = np.cumsum([len(a) for a in arrays])
    return [np.packbits(smaller[e - len(a) : e]).tobytes() if smaller[e - len(a) : e].any() else None for a, e in zip(arrays, ends, strict=True)]


def remove_repeated(docs: DataFrame, n: int = 13, chunk_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs``.

    Words are runs of anything but space and U+0009 to U+000D. The kept words are joined by one
    space. Null and empty texts have no words; a document of fewer than ``n`` words loses none.
    A null doc_id counts as larger than all others; rows of equal doc_id never remove each
    other's words. Columns other than doc_id and text are not read. An empty table gives an
    empty result.

    Anchors go by 32 bits beside the bucket's: two that agree by chance only make a window a
    candidate. Windows go by two hashes of 64 bits each, whatever the size of the corpus.
    """
    chunks, sums = chunked(docs, chunk_bytes)
    v, cover = cover_for(n)
    n_buckets = buckets_for(docs.sparkSession, int(sums["n_words"] * len(cover) / v * 4))

    def send(chunk: Chunk):
        a = Anchors(chunk, n)
        low = a.unique.astype(np.uint32)
        for b, lo, hi in cuts(bucket_of(a.unique, n_buckets)):
            yield b, low[lo:hi].tobytes()

    shared = scratch.table(exchange(chunks, send, lambda parts: _shared(parts, 4)), "anchors")

    def ask(chunk: Chunk, answers: dict) -> pd.DataFrame:
        a = Anchors(chunk, n)
        one, two, ids, _ = distinct_windows(a, chunk, a.candidates(n_buckets, answers))
        rows = np.empty(len(one), dtype=WINDOW)
        rows["one"], rows["two"], rows["id"] = one, two, ids
        sent = [(b, rows[lo:hi].tobytes()) for b, lo, hi in cuts(bucket_of(one, n_buckets))]
        return pd.DataFrame(sent, columns=["bucket", "part"])

    def asked(left: DataFrame) -> DataFrame:
        def each(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
            replies = dict(zip(rhs["bucket"].tolist(), rhs["answer"].tolist(), strict=True))
            done = [ask(Chunk.unpack(x), replies).assign(chunk=k) for k, x in zip(lhs["chunk"], lhs["payload"], strict=True)]
            return pd.concat(done, ignore_index=True)[["chunk", "bucket", "part"]]

        return left.select("chunk", "payload").groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(each, "chunk long, bucket long, part binary")

    def back(group: pd.DataFrame) -> pd.DataFrame:
        got = _smallest(list(group["part"]))
        keep = [i for i, x in enumerate(got) if x is not None]
        return pd.DataFrame({"chunk": group["chunk"].to_numpy()[keep], "bucket": group["bucket"].to_numpy()[keep], "answer": [got[i] for i in keep]}, columns=["chunk", "bucket", "answer"])

    smaller = asked(chunks).groupBy("bucket").applyInPandas(back, "chunk long, bucket long, answer binary")
    answers = shared.unionByName(smaller.withColumn("bucket", -1 - F.col("bucket")))

    def finish(chunk: Chunk, replies: dict) -> pd.DataFrame:
        a = Anchors(chunk, n)
        starts = a.candidates(n_buckets, replies)
        one, _, ids, entry = distinct_windows(a, chunk, starts)
        smaller = np.zeros(len(one), dtype=bool)
        for b, lo, hi in cuts(bucket_of(one, n_buckets)):
            if -1 - b in replies:
                smaller[lo:hi] = np.unpackbits(np.frombuffer(replies[-1 - b], dtype=np.uint8), count=hi - lo).astype(bool)
        gone = starts[smaller[entry] | (ids[entry] < chunk.ids[a.docs[starts]])] if len(starts) else starts
        cover = np.zeros(len(a.words) + 1, dtype=np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + n, -1)
        removed = np.cumsum(cover[:-1]) > 0
        bounds = np.searchsorted(a.docs, np.arange(len(chunk) + 1))
        rows = []
        for k in range(len(chunk)):
            out = removed[bounds[k] : bounds[k + 1]]
            words, lost = chunk.text(k).split(), int(out.sum())
            kept = b" ".join(compress(words, ~out) if lost else words)
            rows.append((None if chunk.id_null[k] else int(chunk.ids[k]), len(words), lost, hashlib.sha256(kept).hexdigest(), *([None if chunk.text_null[k] else kept.decode("utf-8", "replace")] if with_text else [])))
        frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])
        return frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return with_answers(chunks, answers, finish, schema)


__all__ = ["COVERS", "NO_ID", "U64", "cover_for", "remove_repeated"]
