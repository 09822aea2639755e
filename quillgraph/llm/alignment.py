"""Alignment of two tokenisers' tokens over whole documents, by distinct segments.

A document, with one space in front, is cut before runs of white space wherever neither vocabulary
can have a token across the cut, so the tokens of a document are those of its segments end to end.
Each distinct segment of the corpus is tokenised and aligned once: chunks of documents (see
:mod:`quillgraph.llm.chunks`) send their distinct segments to buckets by hash, a bucket aligns what it
was sent once, and the alignments go back to the chunks, where documents are composed. A common word
is sent once by each chunk, whatever the number of its occurrences.

How the cuts are proved: a byte-level vocabulary with its usual pattern never puts white space after
other characters into one piece of text, and its tokens stay in their pieces. A piece vocabulary
merges over the whole text, but only into pieces that it has; so a cut between characters c and w is
safe if no piece holds w behind another character than white space. :class:`Pair` reads that off the
vocabulary; white space that fails the test (such as a carriage return that some piece ends with) is
never a place to cut.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import chunks as ch
from quillgraph.llm import scratch

#: Chunks are larger than elsewhere, as each sends and gets each of its distinct segments.
CHUNK_BYTES = 8 << 20
#: White space of both vocabularies' patterns, as a class of characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
META = "▁"  # stands for a space in pieces


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """A byte-level vocabulary (A) and a piece vocabulary (B) with what is needed to align them."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        spec = json.loads(Path(a_file).read_text(encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError(f"{a_file}: not a byte-level vocabulary with the usual pattern, so no cut is proved")
        letters = _byte_letters()
        specials = {t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if i not in specials}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes: list[bytes | None] = []
        for i, piece in enumerate(pieces):
            if self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(None)
            elif self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.b_bytes.append(piece.replace(META, " ").encode())
        self.meta = self.b.piece_to_id(META)
        if pieces[self.meta] != META or self.b.encode("a", out_type=str)[0][:1] != META:
            raise ValueError(f"{b_file}: adds no space in front")
        plain = [p for i, p in enumerate(pieces) if self.b_bytes[i] is not None and not self.b.is_byte(i)]
        self.pattern = re.compile(self._cuts(plain))

    @staticmethod
    def _cuts(pieces: list[str]) -> str:
        """The pattern of a segment: white space, other characters, and what follows white space that is no place to cut."""
        white = re.compile(f"[{WHITE}]")
        behind = {c for p in pieces for c in p[1:] if white.match(c)}
        spaced = any(a != META and b == META for p in pieces for a, b in zip(p, p[1:], strict=False))
        # a cut at white space but a space also takes that the space put in front of a segment doesn't merge with it
        bad = behind | ({" "} if spaced else set())
        if not bad:
            return f"[{WHITE}]+[^{WHITE}]*"
        never = "".join(f"\\u{ord(c):04x}" for c in sorted(bad))
        return f"[{WHITE}]+[^{WHITE}]*(?:[{never}][{WHITE}]*[^{WHITE}]*)*"

    def segments(self, text: str) -> list[str]:
        """The segments of space + text."""
        return self.pattern.findall(" " + text)

    def tokens_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments, without the space that it adds in front."""
        out = []
        for s, ids in zip(segments, self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1), strict=True):
            if s == " ":
                ids = [self.meta]
            elif s[0] != " ":
                ids = ids[1:] if ids[:1] == [self.meta] else [0]  # 0: not told apart, so the segment counts as not restored
            out.append(ids)
        return out

    def aligned(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], bytes]]:
        """(a ids, b ids, ends of links) of each segment; nothing for those that aren't restored."""
        for s, a, b in zip(segments, (e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)), self.tokens_b(segments), strict=True):
            raw = s.encode()
            parts_a, parts_b = [self.a_bytes.get(i) for i in a], [self.b_bytes[i] for i in b]
            if None in parts_a or None in parts_b or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                yield [], [], b""
            else:
                yield a, b, links(parts_a, parts_b)


def links(parts_a: list[bytes], parts_b: list[bytes]) -> bytes:
    """The links of two cuttings of the same bytes, in order; of each, which of its tokens ends with it: 1 A's, 2 B's, 3 both.

    A group ends with each 3, so ids and ends together say all of an alignment.
    """
    ends = bytearray()
    i = j = 0
    end_a, end_b = len(parts_a[0]), len(parts_b[0])
    while True:
        if end_a == end_b:
            ends.append(3)
            i, j = i + 1, j + 1
            if i == len(parts_a):
                return bytes(ends)
            end_a, end_b = end_a + len(parts_a[i]), end_b + len(parts_b[j])
        elif end_a < end_b:
            ends.append(1)
            i += 1
            end_a += len(parts_a[i])
        else:
            ends.append(2)
            j += 1
            end_b += len(parts_b[j])


@functools.lru_cache(maxsize=2)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def _texts(chunk: ch.Chunk) -> Iterator[tuple[int, str]]:
    """(row, text) of the documents that have one."""
    for k in range(len(chunk)):
        if chunk.offsets[k + 1] > chunk.offsets[k]:
            yield k, chunk.text(k).decode("utf-8", "replace")


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and bytes in one compressed binary, each with its size in front."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(x) for x in raw], dtype=np.int64).tobytes(), *raw]))


def _unpacked(payload: bytes, kinds: list) -> list:
    """What :func:`_packed` was given; ``kinds`` are the number types, None for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        part = raw[at : at + size]
        out.append(part if kind is None else np.frombuffer(part, dtype=kind))
        at += size
    return out


def _pieces(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


class Held:
    """The distinct segments of a chunk in order of their bucket, and each document as places in them."""

    def __init__(self, chunk: ch.Chunk, cut: Pair, n_buckets: int):
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        docs = [(k, np.fromiter(map(seen.__getitem__, cut.segments(text)), dtype=np.int64)) for k, text in _texts(chunk)]
        raw = [s.encode() for s in seen]
        bucket = np.fromiter((zlib.crc32(x) for x in raw), dtype=np.int64, count=len(raw)) * n_buckets >> 32
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(raw), dtype=np.int64)
        place[order] = np.arange(len(raw))
        self.raw, self.bucket = [raw[i] for i in order.tolist()], bucket[order]
        self.docs = [(k, place[x]) for k, x in docs]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        for b, lo, hi in _runs(self.bucket):
            yield b, _packed(np.array([len(x) for x in self.raw[lo:hi]], dtype=np.uint32), b"".join(self.raw[lo:hi]))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
        yield int(values[lo]), lo, hi


#: What a bucket answers for the segments of one message: numbers of A's and B's tokens and of links,
#: then all ids of A, all ids of B, and the ends of all links. A segment that isn't restored has none.
ALIGNED = [np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8]


def _align_bucket(parts: list[bytes], both: Pair) -> list[bytes]:
    """Tokenises and aligns the distinct segments of a bucket once, and answers each message."""
    known: dict[bytes, int] = {}
    asked = []
    for part in parts:
        sizes, data = _unpacked(part, [np.uint32, None])
        asked.append(np.array([known.setdefault(x, len(known)) for x in _pieces(data, sizes)], dtype=np.int64))
    names = [x.decode() for x in known]
    found = [x for at in range(0, len(names), 2000) for x in both.aligned(names[at : at + 2000])]
    flat = [np.fromiter((t for x in found for t in x[i]), dtype=np.uint32) for i in (0, 1)] + [np.frombuffer(b"".join(x[2] for x in found), dtype=np.uint8)]
    sizes = [np.fromiter((len(x[i]) for x in found), dtype=np.int64, count=len(found)) for i in range(3)]
    starts = [np.cumsum(n) - n for n in sizes]
    out = []
    for mine in asked:
        numbers = [n[mine].astype(np.uint32) for n in sizes]
        out.append(_packed(*numbers, *(x[_ragged(s[mine], n[mine])] for x, s, n in zip(flat, starts, sizes, strict=True))))
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``starts`` on, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@functools.lru_cache(maxsize=3)
def _shown(n: int) -> list[str]:
    """Numbers below n as text with what follows them: a comma, a bar or a semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(n)]


class Aligned:
    """The answers of all buckets to a chunk, end to end in the order of its segments."""

    def __init__(self, replies: dict[int, bytes], held: Held):
        got = [_unpacked(replies[b], ALIGNED) for b, _, _ in _runs(held.bucket)]
        n_a, n_b, n_links, a, b, ends = (np.concatenate([np.zeros(0, dtype=kind), *(g[i] for g in got)]).astype(np.int64) for i, kind in enumerate(ALIGNED))
        done_a, done_b = ends & 1, ends >> 1
        at_a, at_b = np.cumsum(done_a) - done_a, np.cumsum(done_b) - done_b
        #: The distinct pairs in order, the pair of each link, and each segment's first link and their number.
        self.pairs, self.code = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        self.n_links = n_links
        self.starts = np.cumsum(n_links) - n_links
        closed = np.concatenate([[0], np.cumsum(ends == 3)])
        self.numbers = np.stack([n_a, n_b, closed[self.starts + n_links] - closed[self.starts], n_links], axis=1)
        self.ok = n_a > 0
        self._tokens = a, b, n_a + n_b, closed[:-1][done_a > 0], closed[:-1][done_b > 0]

    def texts(self) -> list[str]:
        """The groups of each segment, each with a semicolon behind it."""
        a, b, sizes, group_a, group_b = self._tokens
        top = int(max(a.max(initial=0), b.max(initial=0))) + 1
        ids, place = np.concatenate([a, b]), np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        ids, place = ids[order], place[order]
        # a comma within a side, a bar after A's side, a semicolon after B's
        last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, dtype=bool)
        mark = np.where(last, 1 + (place & 1), 0)
        parts = list(map(_shown(top if top > 1 << 16 else 1 << 16).__getitem__, (mark * max(top, 1 << 16) + ids).tolist()))
        ends = np.cumsum(sizes).tolist()
        return ["".join(parts[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]


def _pair_counts(aligned: Aligned, held: Held) -> np.ndarray:
    """In how many of a chunk's restored documents each of its pairs is linked."""
    docs = np.zeros(len(aligned.pairs), dtype=np.int64)
    last_segment, last_pair = np.zeros(len(aligned.ok), dtype=np.int64), np.zeros(len(aligned.pairs), dtype=np.int64)

    def distinct(x: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = np.arange(len(x))
        last[x] = n
        return x[last[x] == n]

    for _, at in held.docs:
        if aligned.ok[at].all():
            some = distinct(at, last_segment)
            docs[distinct(aligned.code[_ragged(aligned.starts[some], aligned.n_links[some])], last_pair)] += 1
    return docs


def _pair_bucket(pairs: np.ndarray, n_buckets: int) -> np.ndarray:
    """All pairs of an id of A are in one bucket."""
    return (pairs >> 32) % n_buckets


def _pair_messages(number: int, aligned: Aligned, docs: np.ndarray, n_buckets: int) -> pd.DataFrame:
    bucket = _pair_bucket(aligned.pairs, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sent = [(b, _packed(aligned.pairs[order[lo:hi]], docs[order[lo:hi]])) for b, lo, hi in _runs(bucket[order])]
    return pd.DataFrame({"chunk": [number] * len(sent), "bucket": [b for b, _ in sent], "part": [x for _, x in sent]}, columns=["chunk", "bucket", "part"])


def _count_bucket(parts: list[bytes]) -> list[bytes]:
    """For each pair of a message: its documents over all chunks, and whether that is the highest of its id of A."""
    got = [_unpacked(part, [np.int64, np.int64]) for part in parts]
    pairs, code = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    count = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(count, code, np.concatenate([g[1] for g in got]))
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] >> 32 != pairs[:-1] >> 32]))
    top = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(pairs))))
    best = (count == top).astype(np.int64)
    return [_packed(count[mine], best[mine]) for mine in np.split(code, np.cumsum([len(g[0]) for g in got])[:-1])]


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _composed(chunk: ch.Chunk, held: Held, aligned: Aligned, counts: dict[int, bytes], n_buckets: int) -> pd.DataFrame:
    """DIGEST of a chunk's documents."""
    bucket = _pair_bucket(aligned.pairs, n_buckets)
    order = np.argsort(bucket, kind="stable")
    facts = np.zeros((len(aligned.pairs), 2), dtype=np.int64)  # best, count of each pair
    for b, lo, hi in _runs(bucket[order]):
        count, best = _unpacked(counts[b], [np.int64, np.int64])
        facts[order[lo:hi], 0], facts[order[lo:hi], 1] = best, count
    upto = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(facts[aligned.code], axis=0)])
    whole = np.concatenate([aligned.numbers, upto[aligned.starts + aligned.n_links] - upto[aligned.starts]], axis=1)
    texts = aligned.texts()
    sums = np.zeros((len(chunk), 6), dtype=np.int64)
    hashes = [""] * len(chunk)
    for k, at in held.docs:
        if aligned.ok[at].all():
            sums[k] = whole[at].sum(axis=0)
            hashes[k] = hashlib.sha256("".join(map(texts.__getitem__, at.tolist()))[:-1].encode()).hexdigest()
    ids = pd.Series(chunk.ids, dtype="Int64").mask(chunk.id_null)
    return pd.DataFrame({"doc_id": ids, **{c: sums[:, i] for i, c in enumerate(_SUMS)}, "groups_sha256": hashes})


def _answered(parts: DataFrame, answer) -> DataFrame:
    """(chunk, bucket, answer): ``answer`` takes all messages of a bucket and returns as many binaries."""

    def back(group: pd.DataFrame) -> pd.DataFrame:
        out = group[["chunk", "bucket"]].assign(answer=answer(list(group["part"])))
        ch.trim()
        return out

    return parts.groupBy("bucket").applyInPandas(back, "chunk long, bucket long, answer binary")


def align(docs: DataFrame, a_file: str, b_file: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """DIGEST of every document: its tokens by both vocabularies, their groups and links.

    Texts that are null or empty, and those that either vocabulary's tokens do not restore byte for
    byte (such as one that holds the piece vocabulary's sign for a space), have no tokens: zeros and
    an empty hash, and their links are not counted. Rows count as documents each, whatever their ids;
    repeated texts count as often as they stand. ``n_best`` and ``count_sum`` rest on the counts over
    all documents. An empty table gives an empty result; other columns are not read. A segment
    without a place to cut is as long as its text.
    """
    chunks, totals = ch.chunked(docs, chunk_bytes)
    n = ch.buckets_for(docs.sparkSession, totals["n_bytes"])

    def align_all(parts):
        return _align_bucket(parts, pair(a_file, b_file))

    aligned = scratch.table(ch.exchange(chunks, lambda chunk: Held(chunk, pair(a_file, b_file), n).messages(), align_all), "aligned")

    def count(chunk: ch.Chunk, replies: dict[int, bytes]) -> pd.DataFrame:
        held = Held(chunk, pair(a_file, b_file), n)
        found = Aligned(replies, held)
        return _pair_messages(chunk.number, found, _pair_counts(found, held), n)

    counted = _answered(ch.with_answers(chunks, aligned, count, "chunk long, bucket long, part binary"), _count_bucket)

    def compose(chunk: ch.Chunk, replies: dict[int, bytes]) -> pd.DataFrame:
        held = Held(chunk, pair(a_file, b_file), n)
        found = Aligned(replies, held)
        return _composed(chunk, held, found, {b - n: x for b, x in replies.items() if b >= n}, n)

    both = aligned.unionByName(counted.withColumn("bucket", F.col("bucket") + n))
    return ch.with_answers(chunks, both, compose, DIGEST)
