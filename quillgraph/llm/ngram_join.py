"""N-gram Jaccard join by filters under several global token orders.

Two sets of which one holds at least a share t of their union must share a token among the
``n - ceil(t n) + 1`` first tokens of each (its prefix), whatever global order the tokens are
taken in. Three orders are used:

1. by document frequency, rarest first, then by hash: its prefixes make the candidates, since
   rare tokens bring few documents together;
2. by the magnitude of the frequency, then by another hash;
3. by a third hash alone.

A pair found under the first order at a token must be able to share enough from there on: what
stands before a pair's first common token in either set is not shared, so a token counts only
if the smaller remainder reaches the overlap that is asked for. Most pairs of a group of
near copies that are too far from each other fall at this, by the rare tokens of each. A pair is
verified only if its prefixes meet under the other two orders as well. Frequencies are counted over all documents by the packed
exchange (:mod:`chunks`); prefix tokens of frequency 1 make no candidates.

Documents with the same set are one node. Candidates of one token are first held only against
one of them (a star): the one with the fewest rarer tokens, which in a group of copies is the
nearest to the original. They are verified and merged into components; a second star has its
centre among those that the first left in other components; what then remains in different
components is held against each other in full. A pair of linked documents thus ends in one component whether it was ever compared or not, and no
group of copies makes all its pairs.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch
from quillgraph.llm.chunks import _ROOTS, U64, Chunk, bucket_of, buckets_for, chunked, exchange, mix, rewrite, rolling, trim, windows, with_answers
from quillgraph.llm.components import components
from quillgraph.llm.substring_dedup import cuts

SALTS = [U64(0x8A5CD789635D2DFF), U64(0x121FD2155C472F96), U64(0xE7037ED1A0B428DB)]
MOST = 255  # frequencies are counted up to here; beyond, all are alike


def shingle_sets(chunk: Chunk, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each document as ascending hashes; a shorter text is one shingle."""
    words, docs = chunk.words(lower=True)
    values, _ = windows(words, docs, n)
    bounds = np.searchsorted(docs, np.arange(len(chunk) + 1))
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n))
    whole = dict(zip(short.tolist(), rolling(words, bounds[short], bounds[short + 1], _ROOTS[0][1]), strict=True))
    none = np.zeros(0, dtype=U64)
    out = []
    for k in range(len(chunk)):
        lo, hi = bounds[k], bounds[k + 1] - n + 1
        out.append(np.unique(values[lo:hi]) if hi > lo else np.array([whole[k]], dtype=U64) if k in whole else none)
    return out


def _count(parts: list[bytes]) -> list[bytes | None]:
    """The document frequency, up to MOST, of every token of each part; None if all are 1."""
    prints, counts = [], []
    for p in parts:
        (n,) = struct.unpack("<q", p[:8])
        prints.append(np.frombuffer(p, dtype="<u4", count=n, offset=8))
        rest = p[8 + 4 * n :]
        counts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(rest), dtype=np.uint8) if rest else np.ones(n, dtype=np.uint8))
    everything, sizes = np.concatenate(prints), np.concatenate(counts).astype(np.int64)
    order = np.argsort(everything)
    key = everything[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    sums = np.minimum(np.add.reduceat(sizes[order], np.flatnonzero(first)), MOST).astype(np.uint8)
    found = np.empty(len(key), dtype=np.uint8)
    found[order] = sums[np.cumsum(first) - 1]
    out, at = [], 0
    for x in prints:
        mine = found[at : at + len(x)]
        at += len(x)
        out.append(zstandard.ZstdCompressor(level=1).compress(mine.tobytes()) if (mine > 1).any() else None)
    return out


def _first(keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest keys."""
    return np.argpartition(keys, n - 1)[:n] if n < len(keys) else np.arange(len(keys))


def shingled(docs: DataFrame, n: int, percent: int, chunk_bytes: int, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """The chunks, and (chunk, row, doc_id, n, class, tokens, second, third, hashes, places) of each document.

    Both are written once. class stands for the set of shingles (null if empty). tokens are the prefix tokens under the
    first order that other documents hold too; only where there are any, second and third have
    the prefixes under the other orders and hashes the whole set.
    """
    chunks, sums = chunked(docs, chunk_bytes, carry)
    n_buckets = buckets_for(docs.sparkSession, sums["n_words"] * 4)

    def send(chunk: Chunk):
        sets = shingle_sets(chunk, n)
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, dtype=U64), None)
        for b, lo, hi in cuts(bucket_of(tokens, n_buckets)):
            many = np.minimum(counts[lo:hi], MOST).astype(np.uint8)
            rest = zstandard.ZstdCompressor(level=1).compress(many.tobytes()) if (many > 1).any() else b""
            yield b, struct.pack("<q", hi - lo) + tokens[lo:hi].astype("<u4").tobytes() + rest

    def each(chunk: Chunk, replies: dict) -> pd.DataFrame:
        sets = shingle_sets(chunk, n)
        tokens = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=U64)
        frequency = np.ones(len(tokens), dtype=np.uint8)
        for b, lo, hi in cuts(bucket_of(tokens, n_buckets)):
            if b in replies:
                frequency[lo:hi] = np.frombuffer(zstandard.ZstdDecompressor().decompress(replies[b]), dtype=np.uint8)
        rows = []
        for k, s in enumerate(sets):
            row = [chunk.number, k, None if chunk.id_null[k] else int(chunk.ids[k]), len(s), None, None, None, None, None, None]
            if len(s):
                f = frequency[np.searchsorted(tokens, s)]
                row[4] = struct.pack("<QQ", int(mix(s ^ SALTS[0]).sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(s ^ SALTS[1]))) ^ len(s))
                size = len(s) + (-percent * len(s) // 100) + 1
                key = (f.astype(U64) << U64(56)) | (mix(s ^ SALTS[0]) >> U64(8))
                at = _first(key, size)
                at = at[np.argsort(key[at])]
                place = np.flatnonzero(f[at] > 1)
                at = at[place]
                if len(at):
                    magnitude = np.log2(f).astype(np.uint64)
                    row[5] = s[at].view(np.int64)
                    row[9] = place.astype(np.int32)
                    row[6] = s[_first((magnitude << U64(56)) | (mix(s ^ SALTS[1]) >> U64(8)), size)].astype(np.uint32).view(np.int32)
                    row[7] = s[_first(mix(s ^ SALTS[2]), size)].astype(np.uint32).view(np.int32)
                    row[8] = s.tobytes()
            rows.append(row)
        return pd.DataFrame(rows, columns=["chunk", "row", "doc_id", "n", "class", "tokens", "second", "third", "hashes", "places"]).astype({"doc_id": "Int64"})

    schema = "chunk long, row int, doc_id long, n long, class binary, tokens array<long>, second array<int>, third array<int>, hashes binary, places array<int>"
    return chunks, scratch.table(with_answers(chunks, exchange(chunks, send, _count), each, schema), "shingled")


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the other two orders and are linked."""

    def beside(df: DataFrame, x: str, columns: list[str]) -> DataFrame:
        return df.join(nodes.select(F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)

    met = beside(beside(pairs, "a", ["second", "third"]), "b", ["second", "third"])
    met = met.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    met = beside(beside(met, "a", ["hashes"]), "b", ["hashes"])

    def check(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, type=pa.bool_()))
            trim()

    return met.select("a", "b", "hashes_a", "hashes_b").mapInArrow(check, "a binary, b binary")


def labelled(rows: DataFrame, percent: int) -> DataFrame:
    """(class, label, low) for every non-empty set: its component and its first row.

    low is (without id, doc_id, chunk, row), so rows without an id come after all others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where("tokens is not null").groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "places", "second", "third", "hashes")))
    nodes = scratch.bucketed(some, "nodes", "class", parts)
    tokens = nodes.select("class", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("class", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    # close in size, and enough left from this token on
    able = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - place, m - spot) >= {percent} * (n + m)")
    labels: DataFrame | None = None

    def centres(of: DataFrame) -> DataFrame:
        middle = F.min(F.struct("place", "class", "n", "label")).alias("c")
        return of.groupBy("token").agg(middle).select("token", F.col("c.class").alias("other"), F.col("c.n").alias("m"), F.col("c.place").alias("spot"), F.col("c.label").alias("far"))

    for turn in ("first star", "second star", "all"):
        known = tokens.withColumn("label", F.col("class"))
        if labels is not None:
            known = tokens.join(labels, F.col("class") == F.col("node"), "left").select("class", "n", "token", "place", F.coalesce("label", "class").alias("label"))
        apart = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
        if turn == "all":
            open_ = known.join(apart, "token")
            other = open_.select("token", F.col("class").alias("other"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("label").alias("far"))
            pairs = open_.join(other, "token").where((F.col("label") < F.col("far")) & able)
        else:
            one = centres(known).join(apart, "token")
            if turn == "second star":
                one = centres(known.join(one.select("token", "far"), "token").where("label != far").drop("far"))
            pairs = known.join(one, "token").where((F.col("label") != F.col("far")) & able)
        pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        linked = scratch.table(_verify(pairs, nodes, percent), "linked")
        if labels is not None:
            start, end = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
            linked = linked.join(start, "a", "left").join(end, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        merged = components(linked)
        if labels is None:
            labels = merged
        else:
            # nodes seen before move to the new label of their old one; new nodes come with theirs
            moved = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
            before = labels.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
            fresh = merged.join(labels.select("node"), "node", "left_anti")
            labels = scratch.table(before.unionByName(fresh), "labels")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "row"))
    lows = rows.where("class is not null").groupBy("class").agg(first.alias("low"))
    return lows.join(labels, F.col("class") == F.col("node"), "left").select("class", F.coalesce("label", "class").alias("label"), "low")


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    A document's set is its distinct shingles of ``n`` words, words being runs of anything but
    space and U+0009 to U+000D with A-Z lower-cased; a text of fewer words is one shingle, and
    null texts and texts without words have an empty set and no links. Two documents link if
    100 times the intersection is ``percent`` times the union at least; component_id is the
    smallest doc_id reachable by links, their own included. Rows that repeat a doc_id are nodes
    of their own; rows without one link like others but are never the smallest (component_id is
    null if no row of the component has an id). Columns other than doc_id and text are not read.
    An empty table gives an empty result.
    """
    _, rows = shingled(docs, n, percent, chunk_bytes)
    lows = labelled(rows, percent)
    least = lows.groupBy("label").agg(F.min("low").alias("least"))
    found = lows.join(least, "label").select("class", F.col("least.doc_id").alias("component_id"))
    # the copies of one text may be a third of all rows; the adaptive skew join splits them
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "class").join(found, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, chunk_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id; all columns stay.

    Of rows that tie, one stays; rows without words all stay. Otherwise as :func:`join_components`.
    """
    chunks, rows = shingled(docs, n, percent, chunk_bytes, carry=True)
    kept = labelled(rows, percent).groupBy("label").agg(F.min("low").alias("low")).select("low.chunk", "low.row")
    kept = kept.unionByName(rows.where("class is null").select("chunk", "row"))
    return rewrite(chunks, kept, lambda chunk, facts: (sorted(facts.column("row").to_pylist()), None), docs)
