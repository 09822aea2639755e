"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it. Each byte, together with a mark
whether its 4 bytes stood among the 40 before, is embedded; learned filters run over the
chunk, rectified and max-pooled to one vector a chunk. The mean and the maximum of the chunks'
vectors give one probability. It is trained on the driver by plain gradient descent (Adam) on a
bounded sample of labelled rows; scoring reads every byte of every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import labelled, scratch
from quillgraph.llm.chunks import Chunk, from_batch, trim

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 16, 4
EMBED, FILTERS = 6, 24
LOOK_BACK = 40
PAD = 512  # the symbol after the end of a text
#: Labelled rows that are learned from, for each label, and the bytes of their texts together.
TRAIN_ROWS, TRAIN_BYTES = 1_500, 16 << 20
#: Chunks that the network takes at a time; bounds the memory of long documents.
SLICE = 256


def marked(data: np.ndarray) -> np.ndarray:
    """Each byte, plus 256 where it and the next 3 stood alike up to LOOK_BACK bytes before."""
    out = data.astype(np.uint16)
    if len(data) > 4:
        four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 4)).view(np.uint32).ravel()
        seen = np.zeros(len(four), dtype=bool)
        for back in range(2, min(LOOK_BACK, len(four) - 1) + 1):
            seen[back:] |= four[back:] == four[:-back]
        out[: len(four)] |= seen.astype(np.uint16) << 8
    return out


def cut(text: bytes) -> np.ndarray:
    """The chunks of a text as rows of symbols, the last one padded; an empty text is one padded chunk."""
    s = marked(np.frombuffer(text, dtype=np.uint8))
    n = max(1, -(-(len(s) - (CHUNK - STEP)) // STEP))
    out = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.uint16)
    out[: len(s)] = s
    return np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, np.sqrt(2 / (WIDTH * EMBED)), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    def columns(self, chunks: np.ndarray) -> np.ndarray:
        """The filters' inputs: (chunk, place, WIDTH * EMBED)."""
        x = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, chunks: np.ndarray, block: int = SLICE) -> np.ndarray:
        """The rectified maximum of each filter over each chunk."""
        out = np.empty((len(chunks), FILTERS), dtype=np.float32)
        for i in range(0, len(chunks), block):
            x = self.columns(chunks[i : i + block])
            out[i : i + block] = (np.ascontiguousarray(x).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(x.shape[0], x.shape[1], FILTERS).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def probabilities(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose chunks begin at ``starts``."""
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        both = np.concatenate([np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts)], axis=1)
        return 1 / (1 + np.exp(-np.clip(both @ self.out + self.bias, -30, 30)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, least_steps: int = 500, batch: int = 32, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on the log loss; each label weighs half of the whole. Small samples get more epochs."""
        epochs = max(epochs, min(60, -(-least_steps // -(-len(texts) // batch))))
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        names = ["embed", "filters", "shift", "out", "bias"]
        first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                picks = order[i : i + batch]
                chunks = np.concatenate([texts[j] for j in picks])
                sizes = np.array([len(texts[j]) for j in picks])
                grads = self._gradients(chunks, sizes, labels[picks].astype(np.float32), weight[picks].astype(np.float32))
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                    move = pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))
                self.embed[PAD] = 0

    def _gradients(self, chunks, sizes, labels, weight) -> dict[str, np.ndarray]:
        n = len(chunks)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place, top = np.empty((n, FILTERS), dtype=np.int64), np.empty((n, FILTERS), dtype=np.float32)
        for i in range(0, n, SLICE):
            x = np.ascontiguousarray(self.columns(chunks[i : i + SLICE]))
            raw = (x.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(x), -1, FILTERS)
            place[i : i + SLICE] = raw.argmax(axis=1)
            top[i : i + SLICE] = raw.max(axis=1) + self.shift
        pool = np.maximum(top, 0)
        mean, high = np.add.reduceat(pool, starts) / sizes[:, None], np.maximum.reduceat(pool, starts)
        both = np.concatenate([mean, high], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ self.out + self.bias, -30, 30)))
        d = (p - labels) * weight / len(labels)
        g = d[doc][:, None] * (self.out[:FILTERS] / sizes[doc][:, None] + self.out[FILTERS:] * (pool == high[doc]))
        g = (g * (top > 0)).astype(np.float32)
        filters, embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for i in range(0, n, SLICE):  # the bytes under each filter's best place
            h = g[i : i + SLICE]
            under = place[i : i + SLICE, :, None] * STRIDE + np.arange(WIDTH)
            symbols = chunks[np.arange(i, min(n, i + SLICE))[:, None, None], under]
            filters += np.einsum("nfk,nf->kf", self.embed[symbols].reshape(len(h), FILTERS, -1), h, optimize=True)
            np.add.at(embed, symbols.ravel(), (h[:, :, None] * self.filters.T[None]).reshape(-1, EMBED))
        return {"embed": embed, "filters": filters, "shift": g.sum(axis=0), "out": both.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Network:
    """A network from whole texts of labelled rows; see :func:`labelled.sample`."""
    rows, known = labelled.sample(docs, labels, label, train_rows, train_bytes // 2)
    if len(set(known.values())) < 2:
        return _constant(set(known.values()))
    got = rows.select("doc_id", "text").toArrow().sort_by("doc_id")  # train_bytes at most, or one text of each label
    texts = [cut(t.as_buffer().to_pybytes()) for t in got.column(1)]
    net = Network()
    net.fit(texts, np.array([known[i] for i in got.column(0).to_pylist()], dtype=np.int64))
    return net


def _constant(labels: set[int]) -> Network:
    """A network that says the same of every text: what the only label says, or nothing."""
    net = Network()
    net.out[:] = 0
    net.bias[:] = 0.0 if not labels else 4.0 if labels == {1} else -4.0
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability of label 1, from the text alone.

    Null texts count as empty; empty texts get the probability of one chunk of padding. Very
    long texts are scored in full, a few hundred chunks at a time. doc_id may be null or repeat.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            out = batch_scores(sent.value, from_batch(batch))
            trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def batch_scores(net: Network, c: Chunk) -> np.ndarray:
    out = np.empty(len(c))
    k = 0
    while k < len(c):  # documents of about 1 MB together
        to = max(k + 1, int(np.searchsorted(c.offsets, c.offsets[k] + (1 << 20), side="right")) - 1)
        texts = [cut(c.text(j)) for j in range(k, to)]
        sizes = np.array([len(t) for t in texts])
        pool = net.pooled(texts[0] if len(texts) == 1 else np.concatenate(texts))
        out[k:to] = net.probabilities(pool, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        k = to
    return out


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all columns stay."""
    spark = docs.sparkSession
    scratch.ship(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels, label, **options))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
            texts = pa.RecordBatch.from_arrays([ids, batch.column(at)], names=["doc_id", "text"])
            good = batch_scores(sent.value, from_batch(texts)) >= threshold
            trim()
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``; ``labels`` holds the rows to learn from.

    See :func:`train` and :func:`score`. Without both labels among the learned rows the score is
    constant: 0.5 without any, else near the one label. An empty table gives an empty result.
    """
    scratch.ship(docs.sparkSession)
    out = score(docs, train(docs, labels, label, **options))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
