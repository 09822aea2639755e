"""Documents as packed chunks, and the exchange that compares fingerprints between chunks.

A chunk holds about ``chunk_bytes`` of whole documents: their ids and the UTF-8 bytes of their
texts, compressed into one binary. Chunks are written to the shared folder once, so every later
pass sees the same chunk under the same number, however often a task is run again.

The exchange is how operators on repeated text find out what other documents hold, without
pairs and without a row for each word: every chunk sends its *distinct* fingerprints, packed
into one binary for each bucket of the fingerprint space; a bucket compares what all chunks sent
and answers each chunk with as many answers, in the order received. A passage that a third of
all documents share is sent once by each chunk, so hot keys shrink before the shuffle, and a
bucket's size depends on the count of distinct fingerprints, not on how often they repeat.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch

CHUNK_BYTES = 2 << 20
#: Buckets of the table of chunks, of which Spark takes 100,000 at most; a task goes through those of a bucket one by one.
MOST_BUCKETS = 16_384
U64 = np.uint64
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_STEP = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)]
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def _byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U64) * _STEP[seed])


_BYTES = [_byte_values(0), _byte_values(1)]
#: Odd multipliers of the rolling sums: first for bytes, then for words; one of each for a seed.
_ROOTS = [[0x5851F42D4C957F2D, 0x2545F4914F6CDD1D], [0xDA942042E4DD58B5, 0x9FB21C651E98DF25]]


def powers(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """root**i and its inverse modulo 2**64, for i below n at least; kept for the next call."""
    have = _powers.get((root, 0))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, root, dtype=U64)
        down = np.full(size, pow(root, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        _powers[(root, 0)] = have
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int) -> np.ndarray:
    """Hash of values[s:e] for each pair of positions, alike wherever the run stands."""
    up, down = powers(root, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give memory that is free back to the system: workers live on, and what one stage needed adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


class Chunk:
    """The documents of one chunk: ids, whether id and text are null, and texts end to end."""

    def __init__(self, ids, id_null, text_null, offsets, data):
        self.ids, self.id_null, self.text_null, self.offsets, self.data = ids, id_null, text_null, offsets, data
        self.number: int | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def pack(self) -> bytes:
        n = len(self.ids)
        raw = b"".join(
            (struct.pack("<q", n), self.ids.tobytes(), self.id_null.tobytes(), self.text_null.tobytes(), self.offsets.tobytes(), self.data.tobytes())
        )
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, payload: bytes) -> Chunk:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
        (n,) = struct.unpack("<q", raw[:8].tobytes())
        at, parts = 8, []
        for kind, count in ((np.int64, n), (np.bool_, n), (np.bool_, n), (np.int64, n + 1)):
            size = np.dtype(kind).itemsize * count
            parts.append(raw[at : at + size].copy().view(kind))
            at += size
        return cls(*parts, raw[at:])

    def words(self, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of every word [^ \\t-\\r]+, in order."""
        data = LOWER[self.data] if lower else self.data
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~SPACE[data]
        cuts = self.offsets[1:-1]
        edge = inside[1:] != inside[:-1]
        starts = np.flatnonzero(edge & inside[1:])
        ends = np.flatnonzero(edge & inside[:-1])
        # a word never runs over the end of its document
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        if len(cuts):
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
        hashes = rolling(_BYTES[seed][data], starts, ends, _ROOTS[seed][0])
        return hashes, np.searchsorted(self.offsets, starts, side="right") - 1


def windows(words: np.ndarray, docs: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it stays in one document) of the n words from each word on."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
    at = np.arange(m)
    return rolling(words, at, at + n, _ROOTS[seed][1]), docs[:m] == docs[n - 1 :]


def to_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(null flags, offsets from 0, bytes) of an Arrow string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flags = column.is_null().to_numpy(zero_copy_only=False)
    if flags.any():
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind, count=first + n + 1)[first:].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return flags, offsets - offsets[0], data


def from_batch(batch: pa.RecordBatch) -> Chunk:
    """A batch whose first two columns are a long id and a text."""
    ids = batch.column(0)
    id_null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    text_null, offsets, data = to_bytes(batch.column(1))
    return Chunk(ids, id_null, text_null, offsets, data)


def pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Chunk, bytes]]:
    """Batches dealt into chunks of about ``limit`` bytes; a longer document is its own chunk.

    With each chunk come the columns after the second, as a compressed Arrow stream.
    """
    held: list[Chunk] = []
    rest: list[pa.RecordBatch] = []
    size = 0

    def others() -> bytes:
        if not rest or not rest[0].num_columns:
            return b""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.Table.from_batches(rest).combine_chunks())
        return sink.getvalue().to_pybytes()

    def joined() -> Chunk:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c.offsets) for c in held]))]).astype(np.int64)
        return Chunk(*(np.concatenate([getattr(c, k) for c in held]) for k in ("ids", "id_null", "text_null")), offsets, np.concatenate([c.data for c in held]))

    for batch in batches:
        whole = from_batch(batch)
        at = 0
        while at < len(whole):
            room = max(0, limit - size)
            to = int(np.searchsorted(whole.offsets, whole.offsets[at] + room, side="right")) - 1
            to = min(max(to, at + (not held)), len(whole))
            if to > at:
                lo, hi = whole.offsets[at], whole.offsets[to]
                held.append(Chunk(whole.ids[at:to], whole.id_null[at:to], whole.text_null[at:to], whole.offsets[at : to + 1] - lo, whole.data[lo:hi].copy()))
                rest.append(batch.slice(at, to - at).select(list(range(2, batch.num_columns))))
                size += int(hi - lo)
                at = to
            if at < len(whole) or size >= limit:
                yield joined(), others()
                held, rest, size = [], [], 0
    if held:
        yield joined(), others()


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: bool = False) -> tuple[DataFrame, dict]:
    """Write (chunk, payload, rest, n_docs, n_bytes, n_words) of ``docs`` and return it with its totals.

    rest holds all columns but text, for :func:`rewrite`; without ``carry`` it is empty and only
    doc_id and text are read.

    The table is in buckets by chunk, so that answers come to the chunks and no text is
    shuffled. It has a file for each chunk; over very large corpora take larger chunks, as far
    as a worker has about 60 bytes of memory for each byte of a chunk.
    """

    def make(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for c, rest in pieces(batches, chunk_bytes):
            inside = ~SPACE[c.data]
            n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum()) + len(c)
            yield pa.RecordBatch.from_pydict({"chunk": [k], "payload": [c.pack()], "rest": pa.array([rest], type=pa.binary()), "n_docs": [len(c)], "n_bytes": [len(c.data)], "n_words": [n_words]})
            k += 1
            trim()

    scratch.ship(docs.sparkSession)
    others = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns) if c != "text"] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    n = n_buckets(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    out = scratch.bucketed(rows.mapInArrow(make, "chunk long, payload binary, rest binary, n_docs long, n_bytes long, n_words long"), "chunks", "chunk", n)
    sums = out.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_bytes", "n_words"))).first()
    return out, sums.asDict()


def n_buckets(shuffle_partitions: int, input_partitions: int) -> int:
    """Of the table of chunks: two for each input partition, as far as Spark takes so many."""
    return min(MOST_BUCKETS, max(shuffle_partitions, 2 * input_partitions))


def buckets_for(spark, n_bytes: int, bucket_bytes: int = 6 << 20) -> int:
    """Buckets that hold about ``bucket_bytes`` each, and at least four for each shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_bytes // bucket_bytes)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, by its high 32 bits; equal parts of the range, so sorted hashes stay in bucket order."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def exchange(chunks: DataFrame, send: Callable, answer: Callable) -> DataFrame:
    """(chunk, bucket, answer): what ``answer`` makes of all that ``send`` gave a bucket.

    ``send(Chunk)`` yields (bucket, bytes); ``answer([bytes, ...])`` returns as many binaries,
    each for the chunk that sent that part, or None for no answer. A bucket is one group.
    """

    def out(batches):
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sent = list(send(Chunk.unpack(payload.as_py())))
                if sent:
                    yield pa.RecordBatch.from_pydict({"chunk": [k] * len(sent), "bucket": [int(b) for b, _ in sent], "part": [x for _, x in sent]})
                trim()

    def back(group: pd.DataFrame) -> pd.DataFrame:
        got = answer(list(group["part"]))
        trim()
        keep = [i for i, x in enumerate(got) if x is not None]
        return pd.DataFrame({"chunk": group["chunk"].to_numpy()[keep], "bucket": group["bucket"].to_numpy()[keep], "answer": [got[i] for i in keep]}, columns=["chunk", "bucket", "answer"])

    parts = chunks.select("chunk", "payload").mapInArrow(out, "chunk long, bucket long, part binary")
    return parts.groupBy("bucket").applyInPandas(back, "chunk long, bucket long, answer binary")


def with_answers(chunks: DataFrame, answers: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make(Chunk, {bucket: answer})`` for each chunk; it returns a pandas frame of ``schema``.

    The chunk's number is its attribute ``number``.
    """

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        replies = dict(zip(right["bucket"].tolist(), right["answer"].tolist(), strict=True))
        done = []
        for number, payload in zip(left["chunk"].tolist(), left["payload"], strict=True):
            chunk = Chunk.unpack(payload)
            chunk.number = number
            done.append(make(chunk, replies))
            trim()
        return pd.concat(done, ignore_index=True) if len(done) != 1 else done[0]

    left = chunks.select("chunk", "payload").groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInPandas(both, schema)


def rewrite(chunks: DataFrame, facts: DataFrame, decide: Callable, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, carried by ``chunks``, with the texts and without the rows that ``decide`` says.

    ``decide(Chunk, facts)`` gets the rows of ``facts`` (keyed by chunk) as an Arrow table and
    returns the row numbers that stay and their texts as a list, or None to keep the texts.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload, rest in zip(left.column("payload").to_pylist(), left.column("rest").to_pylist(), strict=True):
            chunk = Chunk.unpack(payload)
            stay, texts = decide(chunk, right)
            if texts is None:
                texts = [None if chunk.text_null[k] else chunk.text(k).decode("utf-8", "replace") for k in stay]
            columns = pa.ipc.open_stream(rest).read_all().take(pa.array(stay, type=pa.int64())).columns
            columns.insert(at, pa.chunked_array([pa.array(texts, type=pa.string())]))
            out.append(pa.Table.from_arrays(columns, names=schema.names))
            trim()
        return pa.concat_tables(out)

    left = chunks.select("chunk", "payload", "rest").groupBy("chunk")
    return left.cogroup(facts.groupBy("chunk")).applyInArrow(both, schema)
