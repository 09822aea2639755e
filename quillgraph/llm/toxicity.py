"""Toxicity by weak supervision.

Many weak voters look at a document: a lexicon of insults, and patterns (words and word
beginnings) that labelled rows suggest. A generative model of the votes estimates how often each
voter fires on toxic and on other documents, and which voters fire together beyond that, by
expectation-maximisation that starts from the votes and never sees a label but the share of
toxic rows. Its posteriors, not the labels, then train a linear classifier on the counts of
hashed words and word beginnings, which scores every whole text.

Voters, label model and classifier are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import labelled, scratch
from quillgraph.llm.chunks import _BYTES, _ROOTS, LOWER, U64, Chunk, from_batch, rolling

BITS = 22  # features are hashed to 2**BITS places
PREFIXES = (5, 6, 8)  # bytes of a word's beginning that are features beside the word
TRAIN_ROWS, TRAIN_BYTES = 4_000, 64 << 20  # labelled rows of each label that are learned from, and the bytes of all their texts
VOTERS, FEATURES = 400, 6_000  # sizes of the model, whatever the size of the corpus: pattern voters and features
BETTER = 2.0  # how much likelier a voter fires alone on toxic documents, at the least
CHANCE = 11.0  # twice the log likelihood that a dependence of two voters must gain

# Insults that vote from the start; patterns from labelled rows join them.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "dumb", "dumbass", "disgusting",
    "fool", "freak", "garbage", "hate", "idiot", "idiots", "imbecile", "jerk", "kill", "liar",
    "loser", "losers", "lunatic", "moron", "morons", "parasite", "pathetic", "pig", "rat", "retard",
    "scum", "shit", "stupid", "trash", "ugly", "vermin", "vile", "worthless", "idiota", "imbécil",
    "estúpido", "basura", "asqueroso", "idiote", "imbécile", "crétin", "ordure", "dummkopf", "abschaum", "arschloch",
)

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def places(values: np.ndarray, kind: int) -> np.ndarray:
    """The hashed place of words (kind 0) or of their beginnings of ``kind`` bytes."""
    with np.errstate(over="ignore"):
        x = (values + U64(kind)) * U64(0x9E3779B97F4A7C15)
    return (x >> U64(64 - BITS)).astype(np.int64)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, document) of every word and word beginning, and the number of words of each document.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased.
    """
    data = LOWER[chunk.data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    cuts = chunk.offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    docs = np.searchsorted(chunk.offsets, starts, side="right") - 1
    values = _BYTES[0][data]
    out, where = [places(rolling(values, starts, ends, _ROOTS[0][0]), 0)], [docs]
    for k in PREFIXES:
        long = ends - starts > k
        out.append(places(rolling(values, starts[long], starts[long] + k, _ROOTS[0][0]), k))
        where.append(docs[long])
    return np.concatenate(out), np.concatenate(where), np.bincount(docs, minlength=len(chunk))


def lexicon_places() -> np.ndarray:
    raw = [w.encode() for w in LEXICON]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    chunk = Chunk(np.arange(len(raw)), np.zeros(len(raw), bool), np.zeros(len(raw), bool), offsets, np.frombuffer(b"".join(raw), dtype=np.uint8))
    at, docs, _ = features(chunk)
    return np.unique(at[: len(raw)]) if len(docs) else at


class LabelModel:
    """The generative model of the votes: a class, and a forest of voters below it.

    A voter fires with a rate that depends on the class and, if it has a parent, on whether that
    voter fired: voters that repeat one signal hang together, so that it counts once. The forest is
    the spanning tree of the largest conditional mutual information given the class, cut where
    that does not differ from chance. Classes, rates and forest are fitted by
    expectation-maximisation from the votes alone; the prior is given.
    """

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 3):
        """``votes`` is (document, voter) of 0 and 1; the first belief is the share of voters that fire, by rank."""
        self.prior = float(np.clip(prior, 0.005, 0.995))
        votes = votes.astype(np.float64)
        belief = self.first_belief(votes)
        for _ in range(rounds):
            self.estimate(votes, belief)
            before, belief = belief, self.posterior(votes)
            if np.abs(belief - before).max(initial=0) < 1e-4:
                break

    def first_belief(self, votes: np.ndarray) -> np.ndarray:
        """The documents with the most votes, as many as the prior says and ties with them, at 0.9; others at 0.1."""
        fired = votes.sum(axis=1)
        at = min(len(fired) - 1, int(len(fired) * self.prior))
        least = max(1.0, np.sort(fired)[::-1][at]) if len(fired) else 1.0
        return np.where(fired >= least, 0.9, 0.1)

    def estimate(self, votes: np.ndarray, belief: np.ndarray) -> None:
        """Forest and rates by the beliefs."""
        n, width = votes.shape
        weights = (1 - belief, belief)
        together = [votes.T @ (w[:, None] * votes) for w in weights]
        totals = [max(1e-9, w.sum()) for w in weights]
        mutual = sum(_mutual(t, total, n) for t, total in zip(together, totals, strict=True))
        self.parent = _forest(mutual, 2 * n * mutual > CHANCE)
        has, of = self.parent >= 0, np.maximum(self.parent, 0)
        at = np.arange(width)
        self.rates = np.empty((2, 2, width))  # class, whether the parent fired, voter
        for c in (0, 1):
            alone = together[c][at, at]
            plain = (alone + 0.02) / (totals[c] + 0.04)
            fired, both = together[c][of, of], together[c][at, of]
            self.rates[c, 1] = np.where(has, (both + 2 * plain) / (fired + 2), plain)
            self.rates[c, 0] = np.where(has, (alone - both + 2 * plain) / (totals[c] - fired + 2), plain)
        # what tells the classes apart: a vote speaks for the class that it is cast for, and the more so if it stands alone
        self.rates[1] = np.maximum(self.rates[1], self.rates[0] * np.array([[BETTER], [1.0]]))
        self.rates = np.clip(self.rates, 1e-6, 1 - 1e-6)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The belief that each document is toxic."""
        fire, quiet = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        quiet[:, :-1] = 0  # a voter that does not fire abstains; the last one votes either way
        above = votes[:, np.maximum(self.parent, 0)] * (self.parent >= 0)
        x = np.log(self.prior / (1 - self.prior)) + quiet[0].sum()
        x = x + votes @ (fire[0] - quiet[0]) + above @ (quiet[1] - quiet[0]) + (votes * above) @ (fire[1] - quiet[1] - fire[0] + quiet[0])
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _mutual(together: np.ndarray, total: float, n: int) -> np.ndarray:
    """Mutual information of each two voters within one class, times the share of the class."""
    p = np.diag(together) / total
    out = np.zeros_like(together)
    for joint, a, b in (
        (together / total, p[:, None], p[None, :]),
        (p[:, None] - together / total, p[:, None], 1 - p[None, :]),
        (p[None, :] - together / total, 1 - p[:, None], p[None, :]),
        (1 - p[:, None] - p[None, :] + together / total, 1 - p[:, None], 1 - p[None, :]),
    ):
        joint = np.maximum(joint, 0)
        out += joint * np.log(np.maximum(joint, 1e-12) / np.maximum(a * b, 1e-12))
    return out * total / n


def _forest(gain: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The parent of each voter, -1 for roots: Prim's tree of the largest gain, edges that are not real cut."""
    width = len(gain)
    gain = np.where(real, gain, 0.0)
    parent, best, inside = np.full(width, -1), np.zeros(width), np.zeros(width, dtype=bool)
    for _ in range(width):
        k = int(np.argmax(np.where(inside, -1.0, best)))
        inside[k] = True
        nearer = ~inside & (gain[k] > best)
        parent[nearer], best[nearer] = k, gain[k][nearer]
    return parent


class Classifier:
    """A weight for each hashed place, most of them 0."""

    def __init__(self, index: np.ndarray, weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = index, weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.index] = self.weights
        return out

    def scores(self, chunk: Chunk, table: np.ndarray) -> np.ndarray:
        at, docs, words = features(chunk)
        sums = np.bincount(docs, weights=table[at], minlength=len(chunk))
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / _length(words), -30, 30)))


def _length(words: np.ndarray) -> np.ndarray:
    """Counts are held against the root of the length in 50 words; short texts count as 50 words.

    What long texts hold by chance grows with their length and scatters by its root.
    """
    return np.sqrt(np.maximum(words, 50) / 50)


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray) -> Classifier:
    """``rows`` has each document's distinct places, their counts, and its number of words."""
    n, on = len(rows), int(labels.sum())
    sizes = [len(r[0]) for r in rows]
    at, count = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32)
    doc = np.repeat(np.arange(n), sizes)
    words = np.array([r[2] for r in rows])
    # candidates for voters: places that are much more common among toxic documents
    places_, which = np.unique(at, return_inverse=True)
    a = np.bincount(which, weights=labels[doc]) + 0.0
    b = np.bincount(which) - a
    odds = np.log((a + 0.2) / (on + 1)) - np.log((b + 0.2) / (n - on + 1))
    gain = np.where((odds > 1.5) & (a >= 3), odds * np.sqrt(a), 0)
    picks = np.argsort(-gain, kind="stable")[: min(VOTERS, int((gain > 0).sum()))]
    seeds = np.flatnonzero(np.isin(places_, lexicon_places()))
    voters = np.union1d(picks, seeds)
    if not len(voters):
        return Classifier(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((on + 1) / (n - on + 1))))
    number = np.full(len(places_), -1, dtype=np.int64)
    number[voters] = np.arange(len(voters))
    # a pattern votes where it stands more often than once in 200 words: long texts hold it by chance
    # unless it hardly ever stands in other documents
    dense = (number[which] >= 0) & ((count * 200 >= words[doc]) | (odds[which] > 4))
    votes = np.zeros((n, len(voters) + 1), dtype=np.float32)
    votes[doc[dense], number[which[dense]]] = 1
    fired = np.bincount(doc[number[which] >= 0], weights=count[number[which] >= 0], minlength=n)
    votes[:, -1] = fired * 60 >= np.maximum(words, 10)  # patterns of any kind, once in 60 words
    belief = LabelModel(votes, on / n).posterior(votes)
    # the linear classifier: rates of the places that go with the posteriors
    p = np.bincount(which, weights=belief[doc])
    q = np.bincount(which) - p
    odds = np.log((p + 0.3) / (belief.sum() + 1)) - np.log((q + 0.3) / ((1 - belief).sum() + 1))
    gain = np.where(p + q >= 6, np.abs(odds) * np.sqrt(np.maximum(p, q)), 0)
    chosen = np.argsort(-gain, kind="stable")[: min(FEATURES, int((gain > 0).sum()))]
    number = np.full(len(places_), -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    use = number[which] >= 0
    col, row = number[which[use]], doc[use]
    x = count[use] / _length(words)[row]
    weights, bias = np.where(odds[chosen] > 1, odds[chosen], 0) * 0.5, -2.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    balance = np.where(belief > 0.5, 0.5 / max(1e-9, belief.mean()), 0.5 / max(1e-9, (1 - belief).mean()))
    for step in range(1, 301):
        z = bias + np.bincount(row, weights=x * weights[col], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - belief) * balance / n
        g = np.append(np.bincount(col, weights=x * d[row], minlength=len(chosen)) + 1e-5 * weights, d.sum())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Classifier(places_[chosen], weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Classifier:
    """A classifier from whole texts of labelled rows; see :func:`labelled.sample`."""
    chosen, known = labelled.sample(docs, labels, label, train_rows, train_bytes // 2)
    if not known:
        return Classifier(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)

    def count(batches):
        for batch in batches:
            c = from_batch(batch)
            at, doc, words = features(c)
            both, n = np.unique(doc << BITS | at, return_counts=True)
            bounds = np.searchsorted(both >> BITS, np.arange(len(c) + 1))
            rows = [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)]
            counts = [n[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], type=pa.binary()), pa.array([r.tobytes() for r in counts], type=pa.binary()), pa.array(words.astype(np.int64))], names=["doc_id", "places", "counts", "words"])

    got = chosen.select("doc_id", "text").mapInArrow(count, "doc_id long, places binary, counts binary, words long").toArrow().sort_by("doc_id")
    data = [(np.frombuffer(p.as_buffer(), dtype=np.int32), np.frombuffer(c.as_buffer(), dtype=np.int32), w) for p, c, w in zip(got.column(1), got.column(2), got.column(3).to_pylist(), strict=True)]
    if not data:
        return Classifier(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    return _fit(data, np.array([known[i] for i in got.column(0).to_pylist()]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``; ``labels`` holds the rows to learn from.

    Scores see the text alone. Null texts count as empty; texts without words get the score of
    no evidence. Very long texts are scored in full. Without labelled rows the score is 0.5;
    with one label only, the share of that label, smoothed. doc_id may be null or repeat. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch.ship(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels, label, **options))

    def run(batches):
        table = sent.value.table()
        for batch in batches:
            c = from_batch(batch)
            out = np.empty(len(c))
            k = 0
            while k < len(c):  # documents of about 1 MB together
                to = max(k + 1, int(np.searchsorted(c.offsets, c.offsets[k] + (1 << 20), side="right")) - 1)
                lo, hi = c.offsets[k], c.offsets[to]
                part = Chunk(c.ids[k:to], c.id_null[k:to], c.text_null[k:to], c.offsets[k : to + 1] - lo, c.data[lo:hi])
                out[k:to] = sent.value.scores(part, table)
                k = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
