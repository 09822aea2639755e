"""Mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into
blocks of fixed length. The mix is a sequence of output shards with a fixed number of slots. For
each shard, the number of slots of each source is a multinomial draw by what the sources have to
give; draws halve the shards again and again, so the totals meet the targets to within a block
and a task draws for its own shards alone.
The slots of a source are numbered on through all shards, and a slot is mapped to a block through
a permutation that is drawn anew for each pass over the source (a Feistel network on the block
index). Blocks then join slots by index.

Shares are set on the driver from one row for each source; everything else is in proportion to
the data and dealt by block index, so a source with a third of all words is spread like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Sources are planned on the driver, so their number must be bounded.
MOST_SOURCES = 100_000
#: Parts of a source's stream that are summed up together.
SPAN = 1_024


def word_targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Each source's words: ``share`` of the total by weight, ``most`` times its size at most.

    What a source cannot take is dealt again by weight to those still below their bound.
    """
    left = share * sum(sizes)
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def _draw(quota: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Slots of each source: multinomial by ``quota``, what exceeds a source's quota drawn again."""
    drawn = np.zeros_like(quota)
    while missing := slots - int(drawn.sum()):
        open_ = quota - drawn
        drawn += open_ if missing == open_.sum() else np.minimum(rng.multinomial(missing, open_ / open_.sum()), open_)
    return drawn


def shard_counts(quota: np.ndarray, per_shard: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of the shards ``low`` to ``high`` - 1.

    A shard's slots are a multinomial draw by what the sources have to give. Draws halve the
    shards again and again: the left half takes its slots from the quota, the right half what is
    left, each by a seed of its own. So any task finds its shards without the others, and the
    totals are the quota.
    """
    shards = -(-int(quota.sum()) // per_shard)

    def between(a: int, b: int, quota: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if a >= b or b <= low or (high is not None and a >= high):
            return
        if b - a == 1:
            yield a, start, quota
            return
        middle = (a + b) // 2
        left = _draw(quota, (middle - a) * per_shard, np.random.default_rng((seed, a, b)))  # only the last shard is short
        yield from between(a, middle, left, start)
        yield from between(middle, b, quota - left, start + left)

    yield from between(0, shards, np.asarray(quota, dtype=np.int64), np.zeros(len(quota), dtype=np.int64))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..size-1 for each key, at index: a 4-round Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = right ^ (k * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(r * 0x632BE5AB + 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of consecutive numbers."""
    ends = np.append(np.flatnonzero(np.diff(numbers) != 1) + 1, len(numbers))
    at = 0
    for end in ends.tolist():
        if end > at:
            yield int(numbers[at]), int(numbers[end - 1]) + 1
        at = end


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with the number of words of each text, 0 for null; written once."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sized")


class Mix:
    """The plan and the frames of one mix; see :func:`mix_sources`."""

    def __init__(self, docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: float = 3.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 17, split_docs: int = 500):
        self.spark = docs.sparkSession
        scratch.ship(self.spark)
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        rows = sized(docs)
        # sources are told apart by a long, for which the broadcast table takes little memory
        key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("source_key")
        rows = rows.withColumn("source_key", key)
        sums = rows.groupBy("source", "source_key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(sums) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        if len({r.source_key for r in sums}) < len(sums):
            raise ValueError("two sources have the same hash")
        sums.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [int(r["size"]) for r in sums]
        targets = word_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
        self.blocks = np.array([-(-s // block_words) for s in sizes], dtype=np.int64)
        self.quota = np.array([min(round(t * b / s), int(most * b)) if s else 0 for t, s, b in zip(targets, sizes, self.blocks.tolist(), strict=True)], dtype=np.int64)
        plan = [(i, r.source_key, s, float(t)) for i, (r, s, t) in enumerate(zip(sums, sizes, targets, strict=True))]
        self.sources = self.spark.createDataFrame(plan, "source_no int, source_key long, source_size long, target double")

        # where each document stands in its source's stream; the stream is split, and the parts
        # are grouped, so that no task sums up a whole source
        split = max(1, sum(r.n for r in sums) // split_docs)
        bounded = F.broadcast(self.sources)  # at most MOST_SOURCES rows
        known = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(split)).cast("long"))
        known = known.join(bounded, "source_key")
        by = Window.partitionBy("source_no", "part").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
        parts = known.groupBy("source_no", "part").agg(F.sum("size").alias("words")).withColumn("span", F.expr(f"part div {SPAN}"))
        spans = parts.groupBy("source_no", "span").agg(F.sum("words").alias("words"))
        upto = [Window.unboundedPreceding, -1]
        spans = spans.select("source_no", "span", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("span").rowsBetween(*upto)), F.lit(0)).alias("before"))
        within = F.coalesce(F.sum("words").over(Window.partitionBy("source_no", "span").orderBy("part").rowsBetween(*upto)), F.lit(0))
        parts = parts.withColumn("within", within).join(spans, ["source_no", "span"]).select("source_no", "part", (F.col("before") + F.col("within")).alias("base"))
        placed = known.withColumn("row", F.row_number().over(by)).withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        self.placed = placed.join(parts, ["source_no", "part"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))

    def slots(self) -> DataFrame:
        """(shard, source_no, slot, block): every slot of the mix with the block that fills it.

        Each task draws the counts of its own shards; the driver only knows how many there are.
        """
        quota, blocks, per_shard, seed = self.quota, self.blocks, self.shard_slots, self.seed
        shards = -(-int(quota.sum()) // per_shard)

        def fill(batches):
            for batch in batches:
                mine = batch.column(0).to_numpy()
                for low, high in _runs(mine):
                    for shard, first, counts in shard_counts(quota, per_shard, seed, low, high):
                        source = np.repeat(np.arange(len(quota)), counts)
                        slot = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + first[source]
                        size = blocks[source]
                        key = (source + 1) * np.int64(1_000_003) + slot // size * np.int64(7_919)
                        block = permuted(slot % size, size, key)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(source.astype(np.int32)), pa.array(slot), pa.array(block)], names=["shard", "source_no", "slot", "block"])

        return self.spark.range(0, shards, 1, max(1, min(shards, 1 + shards // 64))).mapInArrow(fill, "shard long, source_no int, slot long, block long")

    def pieces(self) -> DataFrame:
        """(source_no, part, row, block, words): the blocks that each document lies in; none if empty."""
        b = F.lit(self.block_words)
        first, last = F.expr(f"start div {self.block_words}"), F.expr(f"(start + size - 1) div {self.block_words}")
        cut = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        return cut.select("source_no", "part", "row", "block", words.alias("words"))

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) for each document."""
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        times = times.hint("merge")  # as many rows as blocks: the planner takes them for as few as shards, and would broadcast them
        got = self.pieces().join(times, ["source_no", "block"]).groupBy("source_no", "part", "row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = self.placed.join(got, ["source_no", "part", "row"], "left")
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    size is the number of words of the text (null: 0). Sources in order of code points, null
    last, take the weights in turn and share ``share`` of all words; a target stops at ``most``
    times the source's size and the excess is shared again. taken is how many words of the
    document the mix takes, repeats counted; it is ``most`` times its size at most. Texts without
    words and sources without words have 0 throughout. Rows that repeat a doc_id, or have none,
    stay rows of their own. Reruns over the same rows give the same mix. Columns other than
    doc_id, text and source are not read. An empty table gives an empty result. The words of a
    source come near its target to within about a block, so ``block_words`` should be well below
    the smallest source. :class:`Mix` has the slots and pieces from which shards are written.
    """
    return Mix(docs, **options).taken()
