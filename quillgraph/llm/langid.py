"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over letters, everything between letters counting as one
break. Its n-grams stand in sorted arrays of their codes and are found by binary search. A text
goes to the language with the lowest cross-entropy per character. A bounded sample of labelled
rows is kept out of the models and calibrates them: a temperature turns the entropies into a
probability, a floor stands for answers that no entropy foretells, and a text is rejected if its
probability is below the cut from which on the stated share of these rows was answered rightly.

Counts are taken from every learned text, in the tasks that read it, and summed by n-gram, and all
of them make the models. Models are cut into shards by the two symbols in the middle of a 4-gram:
the gram, its context and what it backs off to of order 3 stand in one shard, so a shard answers
for its grams as the whole model would. Orders 1 and 2 are as small as the alphabet and go with
every shard. The driver and the tasks hold one shard at a time, however many there are.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch

ORDER = 4
#: n-grams of a shard, all languages together.
SHARD_GRAMS = 2_000_000
#: Labelled rows that calibrate, at most a tenth of a language's; languages of fewer rows than this give none.
CALIBRATION_ROWS, CALIBRATED_FROM = 2_000, 20
#: The share of right answers among those that are not rejected.
TARGET = 0.99
#: Languages are models on the driver and in every task.
MOST_LANGUAGES = 1_000
#: Symbols of texts that a task judges with a shard before it takes the next.
SLICE = 4_000_000


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A number from 1 to 255 for each letter, 0 for other code points; Latin letters get their own."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table[letters] = 1 + letters % 255
    return table


def symbols(text: str) -> np.ndarray:
    """The text's letters as numbers with one 0 for each run of anything else, and one before and after."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.zeros(len(points) + 2, dtype=np.uint8)
    s[1:-1] = _symbols()[points]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that end at each symbol after the first, breaks standing before the text."""
    s = np.concatenate([np.zeros(ORDER - 2, dtype=np.uint32), s.astype(np.uint32)])
    m = len(s) - ORDER + 1
    return s[:m] << 24 | s[1 : m + 1] << 16 | s[2 : m + 2] << 8 | s[3 : m + 3]


def middle(codes: np.ndarray) -> np.ndarray:
    """The two symbols in the middle of each 4-gram."""
    return codes >> np.uint32(8) & np.uint32(0xFFFF)


def discount(ones: int, twos: int) -> float:
    """From how many n-grams of an order were counted once and twice."""
    return min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class Model:
    """One language: for each order, sorted codes with their probability, and contexts with their weight.

    With the tables of the orders below (``lower``) and the discounts of those above, by order, it
    is made of a shard's codes only.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER, lower: tuple = (), discounts: dict[int, float] | None = None):
        by_code = np.argsort(codes)
        codes, counts = codes[by_code].astype(np.uint32), counts[by_code].astype(np.float64)
        levels = [(codes, counts)]
        for k in range(order - 1, len(lower), -1):  # how many different symbols stand before each shorter gram
            u, n = np.unique(levels[-1][0] & np.uint32((1 << 8 * k) - 1), return_counts=True)
            levels.append((u, n.astype(np.float64)))
        self.tables = list(lower)  # from order 1 up: codes, probabilities, context codes, context weights
        for k, (u, n) in enumerate(reversed(levels), len(lower) + 1):
            off = discounts[k] if discounts else discount(np.count_nonzero(n == 1), np.count_nonzero(n == 2))
            contexts, at = np.unique(u >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(at, weights=n), np.bincount(at)
            weight = off * kinds / total
            below = self.probability(u & np.uint32((1 << 8 * (k - 1)) - 1), k - 1)
            p = np.maximum(n - off, 0) / total[at] + weight[at] * below
            self.tables.append((u, p, contexts, weight))

    def probability(self, codes: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Of the last symbol of each gram of length k, given those before."""
        if k == 0:
            return np.full(len(codes), 1 / 256)
        u, p, contexts, weight = self.tables[k - 1]
        if not len(u):  # nothing of this language in the shard
            return self.probability(codes & np.uint32((1 << 8 * (k - 1)) - 1), k - 1)
        at = np.minimum(np.searchsorted(u, codes), len(u) - 1)
        known = u[at] == codes
        out = p[at]
        if not known.all():
            rest = codes[~known]
            c = rest >> np.uint32(8)
            i = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            share = np.where(contexts[i] == c, weight[i], 1.0)
            out[~known] = share * self.probability(rest & np.uint32((1 << 8 * (k - 1)) - 1), k - 1)
        return out


class Identifier:
    """Models of the languages ``names`` in shards, of which one is held at a time.

    ``shards`` and ``base`` are broadcast: by language, a shard's tables of orders 3 and 4, and those
    of orders 1 and 2. Shard i has the grams whose middle is at least ``starts[i]``.
    """

    def __init__(self, names: list[str], starts: np.ndarray, shards: list, base, scale: float = 1.0, floor: float = 0.0, least: float = 0.0):
        self.names, self.starts, self.shards, self.base = names, starts, shards, base
        self.scale, self.floor, self.least = scale, floor, least
        self._at, self._held = -1, None

    def __getstate__(self):
        return self.__dict__ | {"_at": -1, "_held": None}

    def _models(self, i: int) -> list[Model]:
        if i != self._at:
            self._held = None  # free before the next is loaded
            upper, models = self.shards[i].load_from_path(self.shards[i]._path), []
            for x in self.names:
                m = Model.__new__(Model)
                m.tables = [*self.base.value[x], *upper[x]]
                models.append(m)
            self._at, self._held = i, models
        return self._held

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """Nats per symbol under each model and the number of symbols, by text; None without a letter."""
        found = []
        for text in texts if self.names else []:
            s = symbols(text or "")
            found.append(np.unique(grams(s), return_counts=True) if s.any() else None)
        sums = np.zeros((len(texts), len(self.names)))
        for i in range(len(self.shards)):
            for row, x in enumerate(found):
                if x is None:
                    continue
                codes, counts = x
                if len(self.shards) > 1:
                    mine = np.searchsorted(self.starts, middle(codes), side="right") - 1 == i
                    if not mine.any():
                        continue
                    codes, counts = codes[mine], counts[mine]
                sums[row] -= [np.log(m.probability(codes)) @ counts for m in self._models(i)]
        return [None if x is None else (sums[row] / x[1].sum(), int(x[1].sum())) for row, x in enumerate(found)] or [None] * len(texts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, probability, whether it is rejected) of each text."""
        out = []
        for found in self.entropies(texts):
            if found is None:
                out.append(("und", 0.0, True))
                continue
            best = int(np.argmin(found[0]))
            p = float(confidence(found[0], found[1], self.scale, self.floor)[best])
            out.append((self.names[best], p, p < self.least))
        return out


def slices(texts: list[str | None], most: int = SLICE):
    """(start, end) of runs of texts of about ``most`` characters, one text at the least."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > most:
            yield start, i
            start, held = i, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def confidence(entropy: np.ndarray, n: int, scale: float, floor: float = 0.0) -> np.ndarray:
    """Probabilities of the languages; neighbouring symbols depend, so length counts by its root.

    A share ``floor`` of the answers is taken to be any language.
    """
    x = -scale * (entropy - entropy.min()) * np.sqrt(n)
    e = np.exp(x)
    return (1 - floor) * e / e.sum() + floor / len(e)


def _counted(learn: DataFrame) -> DataFrame:
    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = symbols(text)
                if s.any():
                    texts.setdefault(lang, []).append(grams(s))
            for lang, parts in texts.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], codes])
                    codes, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = [codes, n]
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    return learn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _starts(counts: DataFrame, shard_grams: int) -> np.ndarray:
    """Where shards of about ``shard_grams`` start; a middle has at most 65,536 grams of a language."""
    got = counts.groupBy("middle").count().orderBy("middle").collect()  # at most 65,536 rows
    starts, held = [0], 0
    for r in got:
        if held and held + r["count"] > shard_grams:
            starts.append(r.middle)
            held = 0
        held += r["count"]
    return np.array(starts)


def _by_language(df: DataFrame, *columns: str) -> dict[str, list[np.ndarray]]:
    got = df.select("lang", *columns).toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    at, values = lang.indices.to_numpy(), [got.column(c).to_numpy() for c in columns]
    return {name: [v[at == i] for v in values] for i, name in enumerate(lang.dictionary.to_pylist())}


def train(learn: DataFrame, shard_grams: int = SHARD_GRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Identifier:
    """Models from the columns lang and text of ``learn``; rows with a null in either are left out.

    Rows of equal text are kept out of the models together.
    """
    sc = learn.sparkSession.sparkContext
    learn = learn.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    keyed = learn.withColumn("key", F.xxhash64("text"))
    sizes = keyed.groupBy("lang").count().where(F.col("count") >= CALIBRATED_FROM).select("lang").limit(MOST_LANGUAGES + 1).collect()
    aside = F.col("lang").isin([r.lang for r in sizes]) & (F.pmod("key", F.lit(10)) == 0)
    picked = keyed.where(aside).select("key", "lang").orderBy("key", "lang").limit(calibration_rows).collect()
    if picked:
        aside = aside & (F.col("key") <= picked[-1].key)
        learn = keyed.where(~aside).select("lang", "text")
    counted = _counted(learn).withColumn("middle", F.shiftright("code", 8).bitwiseAND(0xFFFF))
    counts = scratch.table(counted.sortWithinPartitions("middle"), "grams")  # sorted, so that a shard reads few pages
    once = [F.count_if(F.col("n") == i).alias(x) for i, x in ((1, "ones"), (2, "twos"))]
    most = {r.lang: discount(r.ones, r.twos) for r in counts.groupBy("lang").agg(*once).collect()}
    if len(most) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(most)
    threes = scratch.table(counts.groupBy("lang", F.col("code").bitwiseAND(0xFFFFFF).alias("code")).agg(F.count("*").alias("n")), "threes")
    less = {r.lang: discount(r.ones, r.twos) for r in threes.groupBy("lang").agg(*once).collect()}
    twos = _by_language(threes.groupBy("lang", F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.count("*").alias("n")), "code", "n")
    base = {x: Model(*twos[x], order=2).tables for x in names}
    starts, shards = _starts(counts, shard_grams), []
    none = [np.zeros(0, dtype=np.int64)] * 2
    for low, high in zip(starts, [*starts[1:], 1 << 16], strict=True) if names else ():
        got = _by_language(counts.where(F.col("middle").between(int(low), int(high) - 1)), "code", "n")
        shards.append(sc.broadcast({x: Model(*got.get(x, none), lower=base[x], discounts={3: less[x], 4: most[x]}).tables[2:] for x in names}))
    out = Identifier(names, starts, shards, sc.broadcast(base))
    if len(names) > 1 and picked:
        out.scale, out.floor, out.least = _calibrated(keyed.where(aside), out, Counter((r.key, r.lang) for r in picked))
    return out


def _calibrated(aside: DataFrame, model: Identifier, picked: Counter) -> tuple[float, float, float]:
    """Temperature and floor of the least loss on the whole texts of the rows ``picked``, and the cut."""

    def measure(batches):
        seen = set()
        for batch in batches:
            keys, langs, texts = (batch.column(i).to_pylist() for i in range(3))
            new = {(k, x): t for k, x, t in zip(keys, langs, texts, strict=True) if (k, x) not in seen}
            seen |= set(new)
            for a, b in slices(list(new.values())):
                mine = list(new)[a:b]
                found = [(k, x, *f) for (k, x), f in zip(mine, model.entropies([new[m] for m in mine]), strict=True) if f is not None]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[3] for f in found], pa.int64())], names=["key", "lang", "entropy", "n"])

    got = aside.select("key", "lang", "text").mapInArrow(measure, "key long, lang string, entropy array<double>, n long").collect()
    found = {(r.key, r.lang): (np.array(r.entropy), r.n) for r in got if (r.key, r.lang) in picked and r.lang in model.names}
    return calibrated([(*found[x], model.names.index(x[1]), picked[x]) for x in sorted(found)])


def calibrated(rows: list[tuple[np.ndarray, int, int, int]]) -> tuple[float, float, float]:
    """Temperature, floor and cut from (entropies, symbols, true language, times) of labelled texts."""
    if not rows:
        return 1.0, 0.0, 0.0
    truth, times = np.array([r[2] for r in rows]), np.array([float(r[3]) for r in rows])
    lowest, best = 1 / (times.sum() + 2), (np.inf, 1.0, 0.0)  # what no mistake among so many rows still allows
    for scale in 2.0 ** np.arange(-8, 4.5, 0.5):
        p = np.array([confidence(e, n, scale)[y] for (e, n, _, _), y in zip(rows, truth, strict=True)])
        for floor in lowest * 2.0 ** np.arange(0, 12):
            if floor < 0.5:
                loss = -(np.log((1 - floor) * p + floor / len(rows[0][0])) * times).sum()
                best = min(best, (loss, float(scale), float(floor)))
    _, scale, floor = best
    p = np.array([confidence(e, n, scale, floor).max() for e, n, _, _ in rows])
    right = np.array([int(np.argmin(e)) for e, _, _, _ in rows]) == truth
    order = np.argsort(-p, kind="stable")
    share = np.cumsum((right * times)[order]) / np.cumsum(times[order])
    whole = np.append(p[order][1:] != p[order][:-1], True)  # rows of equal probability are accepted together
    ends = np.flatnonzero(whole)
    fine = ends[share[ends] >= min(TARGET, share[ends].max())]  # where no cut reaches the target, the best one
    return scale, floor, float(p[order][fine[-1]])


def identify(docs: DataFrame, learned, reject: bool = False, **options) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``.

    ``learned`` is a column condition on the rows whose lang is learned from. Predictions see the
    text alone. lang_pred is a learned language or ``und``: for null texts, texts without a
    letter (score 0), where no language was learned and, with ``reject``, for rejected texts.
    score is the calibrated probability; rejected tells whether it is below the cut from which on
    TARGET of the calibration rows were answered rightly (or the largest share that any cut
    reaches), and holds for ``und`` as well. Ties go
    to the first language by code point. Rows that repeat a doc_id or have none are judged like
    others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    model = train(docs.where(learned), **options)

    def judge(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for a, b in slices(texts) for x in model.predict(texts[a:b])]
            names = ["und" if reject and no else x for x, _, no in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array([p for _, p, _ in found], type=pa.float64()), pa.array([no for _, _, no in found], type=pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")
