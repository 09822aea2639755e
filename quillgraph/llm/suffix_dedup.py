"""Suffix-array dedup of byte strings.

Each byte is removed that lies in a string of ``length`` bytes which also starts anywhere else,
in the same document or another.

Suffix arrays do not cross machines, so equal strings must first meet. Every window of
``length`` bytes is dealt to the bucket of its minimizer, the run of ``GRAM`` bytes in it with
the smallest hash: equal windows hold the same minimizer. Neighbouring windows mostly share one,
so they travel together as one block, the text from the first window's start to the last one's
end. Two exchanges (:mod:`chunks`) bring blocks together:

1. Minimizers and block hashes only. A block whose minimizer stands nowhere else has no repeated
   window. Blocks that are equal as a whole are repeated as a whole.
2. The distinct texts of blocks that share a minimizer but differ, each from one chunk that holds
   it (the others know by 1 that theirs is repeated). A bucket cuts them into shards of bounded size and builds the suffix array of each by Larsson-Sadakane refinement, takes
   common prefixes by Kasai's rule, and looks up windows that another shard of the same
   minimizer may hold by binary search in its suffix array.

The answers are bits for the windows of each block. Copies are folded within a chunk before each
exchange, so a passage that a third of all documents hold is sent once by each chunk.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch
from quillgraph.llm.chunks import _BYTES, _ROOTS, U64, Chunk, bucket_of, buckets_for, chunked, exchange, mix, powers, rewrite, trim, with_answers

GRAM = 64
SHARD_BYTES = 1 << 19
#: Windows whose minimizers are found at a time; bounds the memory of long documents.
SLICE = 1 << 18


# --- suffix arrays -----------------------------------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=U64)
    for j in range(8):
        out <<= U64(8)
        out |= padded[j : j + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by Larsson-Sadakane refinement.

    Ranks by the first h bytes double to 2h: the suffixes of a group that is still tied are
    sorted by the rank of the suffix h further on. Groups that are resolved are never touched
    again. The first round takes 8 bytes at once.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    key = words_at(data)
    sa = np.argsort(key, kind="stable")
    # near the end, zeros after the end look like zero bytes: the shorter suffix comes first
    tail = np.zeros(n, dtype=np.int64)
    tail[max(0, n - 7) :] = n - np.arange(max(0, n - 7), n)
    new = np.ones(n, dtype=bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    if (data == 0).any():
        group = np.cumsum(new)
        length = np.where(tail > 0, tail, 8)
        sa = sa[np.lexsort((length[sa], group))]
        new[1:] |= length[sa[1:]] != length[sa[:-1]]
    rank = np.zeros(n + 1, dtype=np.int64)  # rank 0: past the end
    heads = np.flatnonzero(new)
    first = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[sa] = first + 1
    h = 8
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots) or h >= 2 * n:
            return sa
        at = sa[slots]
        key = (first[slots].astype(U64) << U64(32)) | rank[np.minimum(at + h, n)].astype(U64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[slots] = at[order]
        head = np.ones(len(slots), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        new[slots] = head
        top = np.flatnonzero(head)
        first[slots] = np.repeat(slots[top], np.diff(np.append(top, len(slots))))
        rank[sa[slots]] = first[slots] + 1
        h *= 2


def matched(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """Equal bytes from positions a and b on, at most ``most``; key has 8 bytes of each position."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        differ = key[np.minimum(x, n - 1)] ^ key[np.minimum(y, n - 1)]
        same = differ == 0
        out[live] = step + 8
        if not same.all():
            d = differ[~same]
            lead = np.zeros(len(d), dtype=np.int64)
            for shift in (32, 16, 8):  # whole bytes that agree before the first that differs
                high = (d >> U64(64 - shift)) == 0
                lead += high * (shift // 8)
                d = np.where(high, d << U64(shift), d)
            out[live[~same]] = step + lead
        step += 8
        live = live[same]
        live = live[most[live] > step]
    return np.minimum(out, most)


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, by Kasai's rule.

    In text order, the common prefix loses one byte from a position to the next as long as the
    byte before the position equals the byte before its neighbour; only positions where that
    breaks are compared with their neighbour byte by byte.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    breaks = (before <= 0) | (i == 0)
    inner = np.flatnonzero(~breaks)
    breaks[inner] = data[inner - 1] != data[before[inner] - 1]
    at = np.flatnonzero(breaks)
    near = before[at]
    most = np.where(near >= 0, n - np.maximum(at, near), 0)
    reach = np.zeros(n, dtype=np.int64)
    reach[at] = at + matched(words_at(data), at, np.maximum(near, 0), n, most)
    reach = reach[np.maximum.accumulate(np.where(breaks, i, 0))]
    return np.maximum(reach - i, 0)[sa]


def find(key: np.ndarray, sa: np.ndarray, other: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes at ``starts`` of another text stand in this one.

    Binary search in this text's suffix array for all of them at once; ``key`` and ``other`` are
    the texts' numbers of 8 bytes.
    """
    n, m = len(sa), len(other)
    lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), n, dtype=np.int64)
    both = np.concatenate([key, other])
    most = np.full(len(starts), length, dtype=np.int64)

    def compare(slot):
        """Equal bytes and whether this text's suffix is smaller."""
        at = sa[np.minimum(slot, n - 1)]
        # a suffix may end before the window: it never equals it, and sorts by what it has
        k = matched(both, at, starts + n, n + m, np.minimum(most, n - at))
        ended = k >= n - at
        x = np.minimum(at + k, n - 1)
        y = np.minimum(starts + k, m - 1)
        return k, ended | ((key[x] >> U64(56)) < (other[y] >> U64(56)))

    while True:
        open_ = lo < hi
        if not open_.any():
            break
        mid = (lo + hi) // 2
        k, less = compare(mid)
        less &= k < length
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    k, _ = compare(lo)
    return (lo < n) & (k >= length)


# --- blocks of windows -------------------------------------------------------------------


class Blocks:
    """The blocks of a chunk: windows first..last share a minimizer.

    unique and text_hash are the minimizers and the hashes of the texts of the distinct blocks,
    heads one block of each, entry the distinct block of every block, and copies tells which
    distinct blocks stand in the chunk more than once.
    """

    def __init__(self, chunk: Chunk, length: int):
        self.length, self.data = length, chunk.data
        data, n = chunk.data, len(chunk.data)
        starts = n - length + 1
        parts = [_runs(data, lo, min(lo + SLICE, starts), length, chunk.offsets) for lo in range(0, starts, SLICE)]
        first, last, pick, minimizer = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in range(4))
        if len(parts) > 1:  # a block may go on over the end of a slice
            new = np.ones(len(first), dtype=bool)
            new[1:] = (pick[1:] != pick[:-1]) | (first[1:] != last[:-1] + 1)
            heads = np.flatnonzero(new)
            last = last[np.append(heads[1:], len(first)) - 1]
            first, minimizer = first[heads], minimizer[heads]
        view = memoryview(np.ascontiguousarray(data))
        text = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), dtype=U64, count=len(first))
        order = np.lexsort((text, minimizer))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (minimizer[order][1:] != minimizer[order][:-1]) | (text[order][1:] != text[order][:-1])
        at = np.flatnonzero(head)
        self.first, self.last = first, last
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(head) - 1
        self.heads = order[at]
        self.unique, self.text_hash = minimizer[self.heads].astype(U64), text[self.heads]
        self.copies = np.diff(np.append(at, len(order))) > 1


def _runs(data: np.ndarray, lo: int, hi: int, length: int, offsets: np.ndarray):
    """(first, last, place, hash of the minimizer) of the runs of windows that start in lo..hi-1."""
    gram = min(GRAM, length)
    reach = length - gram + 1
    part = data[lo : hi + length - 1]
    m = len(part) - gram + 1
    up, down = powers(_ROOTS[0][0], SLICE + length)
    sums = np.zeros(len(part) + 1, dtype=U64)
    np.cumsum(_BYTES[0][part] * up[: len(part)], out=sums[1:])
    grams = mix((sums[gram:] - sums[:m]) * down[:m])
    # the smallest hash, leftmost if tied: the high bits of the hash above the position
    bits = U64(20 if m <= 1 << 20 else int(m).bit_length())
    key = np.full(-(-m // reach) * reach, np.iinfo(np.uint64).max, dtype=U64)
    key[:m] = ((grams >> bits) << bits) | np.arange(m, dtype=U64)
    key = key.reshape(-1, reach)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    count = hi - lo
    pick = (np.minimum(right[:count], left[reach - 1 : reach - 1 + count]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(lo, hi), side="right")  # the document after the one it starts in
    valid = np.arange(lo, hi) + length <= offsets[np.minimum(doc, len(offsets) - 1)]
    change = np.ones(count, dtype=bool)
    change[1:] = (pick[1:] != pick[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(change)
    last = np.append(runs[1:], count) - 1
    ok = valid[runs]
    runs, last = runs[ok], last[ok]
    return runs + lo, last + lo, pick[runs] + lo, grams[pick[runs]]


def _cuts(buckets: np.ndarray):
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(buckets)], strict=True):
        if hi > lo:
            yield int(buckets[lo]), lo, hi


BLOCK = np.dtype([("minimizer", "<u4"), ("text", "<u8")])


def _meet(parts: list[bytes]) -> list[bytes | None]:
    """Two bits for each block: its text stands in another part; its text is wanted.

    Wanted are the texts of a minimizer that has several, each from the first part that holds it:
    however many chunks share a passage, its text travels once.
    """
    arrays = [np.frombuffer(p, dtype=BLOCK) for p in parts]
    rows = np.concatenate(arrays)
    order = np.lexsort((rows["text"], rows["minimizer"]))
    a, b = rows["minimizer"][order], rows["text"][order]
    new_a = np.ones(len(a), dtype=bool)
    new_a[1:] = a[1:] != a[:-1]
    new_b = new_a.copy()
    new_b[1:] |= b[1:] != b[:-1]
    group_a, group_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    texts = np.bincount(group_a[new_b], minlength=group_a[-1] + 1)
    same, other = np.empty(len(a), dtype=bool), np.empty(len(a), dtype=bool)
    same[order] = np.bincount(group_b)[group_b] > 1
    other[order] = new_b & (texts[group_a] > 1)
    out, at = [], 0
    for x in arrays:
        s, o = same[at : at + len(x)], other[at : at + len(x)]
        at += len(x)
        out.append(np.packbits(np.concatenate([s, o])).tobytes() if (s | o).any() else None)
    return out


def _send_texts(blocks: Blocks, chosen: np.ndarray) -> bytes:
    """The texts of the chosen distinct blocks with their minimizers, compressed."""
    lo, hi = blocks.first[blocks.heads[chosen]], blocks.last[blocks.heads[chosen]] + blocks.length
    sizes = (hi - lo).astype("<u4")
    raw = struct.pack("<q", len(chosen)) + sizes.tobytes() + blocks.unique[chosen].astype("<u8").tobytes()
    raw += b"".join(blocks.data[a:b].tobytes() for a, b in zip(lo, hi, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def repeated_windows(texts: list[bytes], keys: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each of these distinct texts, the windows that stand twice among all of them.

    Only texts of equal key are held against each other across shards: equal windows have equal
    keys. Within a shard, any other equal window counts too, which can only be a true repeat.
    """
    order = np.argsort(keys, kind="stable")
    shards, held, size = [], [], 0
    for i in order.tolist():
        if held and size + len(texts[i]) > shard_bytes:
            shards.append(held)
            held, size = [], 0
        held.append(i)
        size += len(texts[i]) + 1
    if held:
        shards.append(held)
    out = [np.zeros(0, dtype=bool)] * len(texts)
    open_: list[tuple] = []  # earlier shards that end in the key with which the next one starts
    for shard in shards:
        joined = b"\xff".join(texts[i] for i in shard)  # 0xFF stands in no UTF-8 text
        data = np.frombuffer(joined, dtype=np.uint8)
        sa = suffix_array(data)
        prefix = common_prefixes(data, sa)
        twice = prefix >= length
        twice[:-1] |= prefix[1:] >= length
        flags = np.zeros(len(data), dtype=bool)
        flags[sa] = twice
        sizes = np.array([len(texts[i]) for i in shard])
        starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]).astype(np.int64)
        key8 = words_at(data)
        if open_ and keys[open_[-1][3][-1]] != keys[shard[0]]:
            open_ = []
        mine = np.concatenate([s + np.arange(len(texts[i]) - length + 1) for s, i in zip(starts, shard, strict=True) if open_ and keys[i] == keys[shard[0]]] or [np.zeros(0, dtype=np.int64)])
        for sa_b, key_b, flags_b, shard_b, starts_b in open_:
            flags[mine[find(key_b, sa_b, key8, mine, length)]] = True
            theirs = np.concatenate([s + np.arange(len(texts[i]) - length + 1) for s, i in zip(starts_b, shard_b, strict=True) if keys[i] == keys[shard[0]]])
            flags_b[theirs[find(key8, sa, key_b, theirs, length)]] = True
        for i, s in zip(shard, starts, strict=True):
            out[i] = flags[s : s + len(texts[i]) - length + 1]  # a view: later shards may still add to it
        open_ = [x for x in open_ if keys[x[3][-1]] == keys[shard[-1]]] + [(sa, key8, flags, shard, starts)]
    return out


def _compare(parts: list[bytes], length: int) -> list[bytes | None]:
    """For each part, the bits of all windows of its blocks in order."""
    known: dict[tuple[int, bytes], int] = {}
    texts: list[bytes] = []
    keys: list[int] = []
    asked, often = [], set()
    for p in parts:
        raw = zstandard.ZstdDecompressor().decompress(p)
        (n,) = struct.unpack("<q", raw[:8])
        sizes = np.frombuffer(raw, dtype="<u4", count=n, offset=8)
        minimizers = np.frombuffer(raw, dtype="<u8", count=n, offset=8 + 4 * n).tolist()
        at, mine = 8 + 12 * n, []
        for size, key in zip(sizes.tolist(), minimizers, strict=True):
            text = raw[at : at + size]
            at += size
            k = known.setdefault((key, text), len(texts))
            if k == len(texts):
                texts.append(text)
                keys.append(key)
            else:
                often.add(k)
            mine.append(k)
        asked.append(mine)
    flags = repeated_windows(texts, np.array(keys, dtype=U64), length)
    for k in often:
        flags[k] = np.ones(len(flags[k]), dtype=bool)
    out = []
    for mine in asked:
        bits = np.concatenate([flags[k] for k in mine])
        out.append(np.packbits(bits).tobytes() if bits.any() else None)
    return out


class _Plan:
    """The chunks of a table, what is known of their windows, and how to read it."""

    def __init__(self, docs: DataFrame, length: int, chunk_bytes: int, carry: bool):
        self.length = length
        self.chunks, self.answers, self.n_meet, self.n_text = _compared(docs, length, chunk_bytes, carry)

    def gone(self):
        """A function that marks the removed bytes of a chunk, given its answers."""
        length, n_meet, n_text = self.length, self.n_meet, self.n_text
        return lambda chunk, replies: _removed(chunk, replies, length, n_meet, n_text)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) for each row of ``docs``.

    n_spans counts the maximal removed runs of bytes; kept_sha256 is of the remaining bytes end to
    end, and text is what they read, without parts of characters that cuts leave (null stays
    null). Null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Two rows
    of equal text remove each other, whatever their ids; doc_id may be null. Columns other than
    doc_id and text are not read. An empty table gives an empty result.

    The removed bytes are exact but for two strings that agree in 96 bits of hash beside the
    bucket's by chance.
    """
    plan = _Plan(docs, length, chunk_bytes, carry=False)
    mark = plan.gone()

    def finish(chunk: Chunk, replies: dict) -> pd.DataFrame:
        gone = mark(chunk, replies)
        rows = []
        for k in range(len(chunk)):
            lo, hi = chunk.offsets[k], chunk.offsets[k + 1]
            out = gone[lo:hi]
            lost = int(np.count_nonzero(out))
            spans = int(out[:1].sum() + np.count_nonzero(out[1:] & ~out[:-1])) if lost else 0
            kept = (chunk.data[lo:hi][~out] if lost else chunk.data[lo:hi]).tobytes()
            rows.append((None if chunk.id_null[k] else int(chunk.ids[k]), int(hi - lo), lost, spans, hashlib.sha256(kept).hexdigest(), None if chunk.text_null[k] else kept.decode("utf-8", "ignore")))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]).astype({"doc_id": "Int64"})

    return with_answers(plan.chunks, plan.answers, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, length: int = 400, chunk_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text; all rows and all other columns stay.

    Parts of characters that are left at cuts go too. A text that is repeated as a whole becomes
    empty; a null text stays null. Otherwise as :func:`remove_repeated_bytes`.
    """
    plan = _Plan(docs, length, chunk_bytes, carry=True)
    mark = plan.gone()

    def decide(chunk: Chunk, facts):
        gone = mark(chunk, dict(zip(facts.column("bucket").to_pylist(), facts.column("answer").to_pylist(), strict=True)))
        texts = []
        for k in range(len(chunk)):
            lo, hi = chunk.offsets[k], chunk.offsets[k + 1]
            kept = chunk.data[lo:hi][~gone[lo:hi]].tobytes()
            texts.append(None if chunk.text_null[k] else kept.decode("utf-8", "ignore"))
        return range(len(chunk)), texts

    return rewrite(plan.chunks, plan.answers, decide, docs)


def _read(blocks: Blocks, replies: dict, n_meet: int) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct blocks are repeated as a whole, and which have a minimizer with other texts."""
    same, other = blocks.copies.copy(), np.zeros(len(blocks.unique), dtype=bool)
    for b, lo, hi in _cuts(bucket_of(blocks.unique, n_meet)):
        if b in replies:
            bits = np.unpackbits(np.frombuffer(replies[b], dtype=np.uint8), count=2 * (hi - lo)).astype(bool)
            same[lo:hi] |= bits[: hi - lo]
            other[lo:hi] |= bits[hi - lo :]
    return same, np.flatnonzero(other)


def _compared(docs: DataFrame, length: int, chunk_bytes: int, carry: bool):
    """The chunks, the answers of both exchanges, and the numbers of their buckets."""
    chunks, sums = chunked(docs, chunk_bytes, carry)
    spark = docs.sparkSession
    windows_each = max(1, (length - min(GRAM, length) + 2) // 2)
    n_meet = buckets_for(spark, sums["n_bytes"] * BLOCK.itemsize // windows_each)
    n_text = buckets_for(spark, sums["n_bytes"], SHARD_BYTES)

    def send(chunk: Chunk):
        blocks = Blocks(chunk, length)
        rows = np.empty(len(blocks.unique), dtype=BLOCK)
        rows["minimizer"], rows["text"] = blocks.unique.astype(np.uint32), blocks.text_hash
        for b, lo, hi in _cuts(bucket_of(blocks.unique, n_meet)):
            yield b, rows[lo:hi].tobytes()

    met = scratch.table(exchange(chunks, send, _meet), "minimizers")

    def ask(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        replies = dict(zip(rhs["bucket"].tolist(), rhs["answer"].tolist(), strict=True))
        rows = []
        for k, payload in zip(lhs["chunk"], lhs["payload"], strict=True):
            blocks = Blocks(Chunk.unpack(payload), length)
            _, other = _read(blocks, replies, n_meet)
            for b, lo, hi in _cuts(bucket_of(blocks.unique[other], n_text)):
                rows.append((k, b, _send_texts(blocks, other[lo:hi])))
            trim()
        return pd.DataFrame(rows, columns=["chunk", "bucket", "part"])

    def back(group: pd.DataFrame) -> pd.DataFrame:
        got = _compare(list(group["part"]), length)
        trim()
        keep = [i for i, x in enumerate(got) if x is not None]
        return pd.DataFrame({"chunk": group["chunk"].to_numpy()[keep], "bucket": group["bucket"].to_numpy()[keep], "answer": [got[i] for i in keep]}, columns=["chunk", "bucket", "answer"])

    asked = chunks.select("chunk", "payload").groupBy("chunk").cogroup(met.groupBy("chunk")).applyInPandas(ask, "chunk long, bucket long, part binary")
    compared = asked.groupBy("bucket").applyInPandas(back, "chunk long, bucket long, answer binary")
    answers = met.unionByName(compared.withColumn("bucket", -1 - F.col("bucket")))

    return chunks, answers, n_meet, n_text


def _removed(chunk: Chunk, replies: dict, length: int, n_meet: int, n_text: int) -> np.ndarray:
    """The bytes of a chunk that repeated windows cover."""
    blocks = Blocks(chunk, length)
    same, other = _read(blocks, replies, n_meet)
    change = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    whole = same[blocks.entry] if len(blocks.entry) else np.zeros(0, dtype=bool)
    np.add.at(change, blocks.first[whole], 1)
    np.add.at(change, blocks.last[whole] + length, -1)
    if len(other):
        each = (blocks.last - blocks.first + 1)[blocks.heads[other]]
        bits: dict[int, np.ndarray] = {}
        for b, lo, hi in _cuts(bucket_of(blocks.unique[other], n_text)):
            if -1 - b in replies:
                got = np.unpackbits(np.frombuffer(replies[-1 - b], dtype=np.uint8), count=int(each[lo:hi].sum())).astype(bool)
                at = np.concatenate([[0], np.cumsum(each[lo:hi])])
                for j in range(lo, hi):
                    part = got[at[j - lo] : at[j - lo + 1]]
                    if part.any():
                        bits[int(other[j])] = np.flatnonzero(part)
        for i in np.flatnonzero(np.isin(blocks.entry, list(bits))).tolist() if bits else []:
            starts = blocks.first[i] + bits[int(blocks.entry[i])]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0
