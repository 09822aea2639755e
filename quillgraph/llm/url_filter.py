"""URL filters by a Bloom filter cascade.

A listed set of keys is encoded against the complete universe of keys that occur in the corpus:
the first filter holds the listed keys, the second those other keys that the first lets through
by mistake, the third the listed keys that the second lets through, and so on until a filter
makes no mistake on the universe. A key of the universe is listed if the first filter that does
not have it stands at an even level. The answer is exact, and every task gives it from a few
bits for each listed key, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch

#: A cascade is sent to all tasks; its filters together may take this much.
MOST_BYTES = 64 << 20
MOST_MISTAKES = 10_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strings(**columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=pa.string()) for v in columns.values()], names=list(columns))


class Bloom:
    """A filter for a stated number of keys and rate of mistakes; the seed sets its hashes."""

    def __init__(self, n: int, rate: float, seed: int):
        bits = max(8, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2))
        self.n_bits, self.n_hashes, self.seed = bits, max(1, round(-math.log2(rate))), seed
        self.bits = np.zeros(-(-bits // 8), dtype=np.uint8)

    def _places(self, key: str) -> list[int]:
        x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=self.seed)
        a, b = x >> 64, (x & 0xFFFFFFFFFFFFFFFF) | 1
        return [(a + i * b) % self.n_bits for i in range(self.n_hashes)]

    def add(self, key: str) -> None:
        for p in self._places(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def has(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """The levels; ``key in cascade`` is exact for the listed keys and the universe it was built on."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if not level.has(key):
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def build(listed: Iterable[str], universe: DataFrame, rate: float | None = None, later_rate: float = 0.5) -> Cascade:
    """A cascade for ``listed`` against the string column of ``universe`` (nulls are ignored).

    The first level's rate makes about as many mistakes as there are listed keys, unless given.
    Only those mistakes come to the driver, never the universe.
    """
    spark = universe.sparkSession
    name = universe.columns[0]
    listed = sorted(set(listed))
    if not listed:
        return Cascade([])
    if rate is None:
        n = universe.agg(F.approx_count_distinct(name)).first()[0]
        rate = min(0.5, max(1e-9, len(listed) / max(1, 2 * n)))
    first = Bloom(len(listed), rate, 1)
    for key in listed:
        first.add(key)
    if len(first.bits) > MOST_BYTES:
        raise ValueError(f"{len(listed)} listed keys need {len(first.bits)} bytes; {MOST_BYTES} are sent at most")
    sent, known = spark.sparkContext.broadcast(first), spark.sparkContext.broadcast(frozenset(listed))

    def mistakes(batches):
        for batch in batches:
            keys = set(batch.column(0).to_pylist()) - {None}
            yield _strings(key=[k for k in keys if sent.value.has(k) and k not in known.value])

    wrong = universe.select(name).mapInArrow(mistakes, "key string").distinct()
    wrong = sorted(r.key for r in wrong.limit(MOST_MISTAKES + 1).collect())
    if len(wrong) > MOST_MISTAKES:
        raise ValueError(f"the first level lets more than {MOST_MISTAKES} keys through; give a smaller rate")
    levels, include, exclude = [first], wrong, listed
    while include:
        level = Bloom(len(include), later_rate, len(levels) + 1)
        for key in include:
            level.add(key)
        levels.append(level)
        include, exclude = [k for k in exclude if level.has(k)], include
    return Cascade(levels)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path): both empty for null urls and those without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))


def page_keys(host: str, path: str, sizes: list[int]) -> list[str]:
    """The keys under which a rule for this url may be listed, longest first."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    ends = [path[:n] for n in sizes if n <= len(path)]
    return sorted({h + p for h in hosts for p in ends}, key=lambda k: (-len(k), k))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", rate: float | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    A rule is (action, host, path) with action allow or block. It fits urls of its host or a
    subdomain whose path starts with its own; the longest wins. The keys of the allow rules and
    of the block rules are two lists, each a cascade over all (host suffix, path start) keys of
    the corpus. Where no key is listed, rule is null and the verdict is ``default``. host is what
    stands after the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lower-cased; path goes on
    to ``?`` or ``#``; null urls and those without ``://`` have both empty. Rows that repeat a
    url are judged alike; page_id may be null. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    scratch.ship(spark)
    urls = parsed(pages)
    sizes = sorted({len(p) for _, _, p in rules})

    def keys(batches):
        for batch in batches:
            urls = set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield _strings(key=sorted({k for h, p in urls for k in page_keys(h, p, sizes)}))

    universe = urls.select("host", "path").mapInArrow(keys, "key string")
    lists = {a: build([h + p for x, h, p in rules if x == a], universe, rate) for a in ("allow", "block")}
    sent = spark.sparkContext.broadcast(lists)

    def decide(batches):
        for batch in batches:
            found: dict[tuple[str, str], tuple[str | None, str]] = {}
            rule, verdict = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (h, p) not in found:
                    found[h, p] = next(((k, a) for k in page_keys(h, p, sizes) for a in ("block", "allow") if k in sent.value[a]), (None, default))
                rule.append(found[h, p][0])
                verdict.append(found[h, p][1])
            more = _strings(rule=rule, verdict=verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.columns], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.select("page_id", "host", "path").mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string")
