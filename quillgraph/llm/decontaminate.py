"""Benchmark decontamination by a generalised suffix automaton.

The automaton of the normalised items is built on the driver and sent to every task; training
words stream through it, and at each word it gives the longest run ending there that stands in
some item. A run of ``n`` words or more, or a whole shorter item, hits its words.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch
from quillgraph.llm.chunks import from_batch, trim

#: The items are held on the driver and sent to all tasks; beyond this many bytes that is refused.
MOST_ITEM_BYTES = 64 << 20


def _table() -> bytes:
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    low = [c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)]
    return bytes(c if c in keep else 0x20 for c in low)


TABLE = _table()


def normal_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        items = [(i, w) for i, w in items if w]
        numbered = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items]
        self.ids = sorted({i for i, _ in numbered})
        index = {i: k for k, i in enumerate(self.ids)}
        for i, words in numbered:
            last = 0
            for w in words:
                last = self._add(last, w, ends)
                ends[last].add(index[i])
        # an item reaches all states on the suffix links of its prefixes
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        whole: dict[int, list[tuple[int, int]]] = {}
        for i, words in numbered:
            if len(words) < n:
                v = 0
                for w in words:
                    v = self.next[v][w]
                whole.setdefault(v, []).append((len(words), index[i]))
        # of each state: the items that hold its last n words, and the short items it ends with
        self.long: list[frozenset[int] | None] = [None] * len(self.next)
        self.short: list[list[tuple[int, int]] | None] = [None] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= n:
                self.long[v] = self.long[up] if self.length[up] >= n else frozenset(ends[v])
            own = whole.get(v, []) + ((self.short[up] or []) if up >= 0 else [])
            self.short[v] = own or None
        sizes = [min(len(words), n) for _, words in numbered]
        self.least = min(sizes, default=0)
        pairs = {(a << 32) | b for _, words in numbered for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _add(self, last: int, w: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q, ends)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q, ends)
        return new

    def _clone(self, p: int, w: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        ends.append(set())
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit runs (from, to) of these words, in order of their ends, and the items found."""
        if not self.least or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = ids >= 0
        # an occurrence is a run of neighbours that some item has as neighbours too
        joined = np.zeros(len(ids), dtype=bool)  # a word and the one before it
        if len(self.pairs) and len(ids) > 1:
            at = np.flatnonzero(known[1:] & known[:-1])
            codes = (ids[at] << 32) | ids[at + 1]
            k = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined[at[self.pairs[k] == codes] + 1] = True
        starts = np.flatnonzero(known & ~joined)
        stops = np.append(np.flatnonzero(~joined[1:] & known[:-1]) + 1, len(ids)) if known[-1] else np.flatnonzero(~joined[1:] & known[:-1]) + 1
        long_enough = stops - starts >= self.least
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        nxt, link, length, n = self.next, self.link, self.length, self.n
        for a, b in zip(starts[long_enough].tolist(), stops[long_enough].tolist(), strict=True):
            v = m = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while v > 0 and w not in nxt[v]:
                    v = link[v]
                    m = length[v]
                if w in nxt[v]:
                    v = nxt[v][w]
                    m += 1
                else:
                    v = m = 0
                    continue
                if m >= n:
                    spans.append((i + 1 - n, i + 1))
                    if self.long[v]:
                        items |= self.long[v]
                for size, item in self.short[v] or ():
                    if size <= m:
                        spans.append((i + 1 - size, i + 1))
                        items.add(item)
        return spans, items


def load_items(benchmark: DataFrame) -> list[tuple[int, list[bytes]]]:
    """The items on the driver, after their size is checked."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MOST_ITEM_BYTES:
        raise ValueError(f"the items have {size} bytes; the automaton takes {MOST_ITEM_BYTES} at most")
    return [(r.item_id, normal_words(r.text.encode())) for r in rows.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, coverage: float = 0.05) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A window is ``n`` consecutive words of an item, or the whole of a shorter item; a word in
    an occurrence of one is hit, and a document is contaminated if it has a hit word and at least
    ``coverage`` of its words are hit. items_sha256 is of the ids of the items with occurring
    windows, sorted as strings and joined by commas. Null and empty texts and texts without words
    give 0 words and no hit; items that are null, without words or without an id have no window;
    rows that repeat an item_id count as one item with the windows of all. doc_id may be null.
    Columns other than doc_id and text (item_id and text) are not read.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    automaton = spark.sparkContext.broadcast(Automaton(load_items(benchmark), n))
    share = Fraction(str(coverage))

    def scan(batches):
        a = automaton.value
        names = [str(i) for i in a.ids]
        for batch in batches:
            c = from_batch(batch)
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
            for k in range(len(c)):
                words = normal_words(c.text(k))
                spans, items = a.hits(words)
                hit = reach = 0
                for lo, hi in _merged(spans):
                    hit += hi - max(lo, reach)
                    reach = hi
                out["n_words"].append(len(words))
                out["n_hit"].append(hit)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(names[i] for i in items)).encode()).hexdigest())
                out["contaminated"].append(hit > 0 and share.denominator * hit >= share.numerator * len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in out.values())], names=["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, coverage: float = 0.05, strip: bool = False) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept, rows of null doc_id or text included.

    With ``strip``, the hit runs of the documents that stay are cut out too: the words from the
    first to the last hit of each run go, with what stands between them.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    automaton = spark.sparkContext.broadcast(Automaton(load_items(benchmark), n))
    share, at = Fraction(str(coverage)), docs.columns.index("text")

    def keep(batches):
        a = automaton.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            stay = []
            for k, text in enumerate(texts):
                raw = (text or "").encode()
                words = normal_words(raw)
                spans = _merged(a.hits(words)[0])
                hit = sum(hi - lo for lo, hi in spans)
                stay.append(not (hit > 0 and share.denominator * hit >= share.numerator * len(words)))
                if strip and spans and stay[-1]:
                    texts[k] = _without(raw, spans)
            if strip:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))
            trim()
            yield batch.filter(pa.array(stay, type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    flat = np.frombuffer(raw.translate(TABLE), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, reach = [], 0
    for lo, hi in spans:
        out.append(raw[reach : starts[lo]])
        reach = ends[hi - 1]
    return b"".join([*out, raw[reach:]]).decode("utf-8", "replace")
