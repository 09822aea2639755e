"""Language identification, quality and toxicity on held-out rows, and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op2_language_id(spark, SF).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").toPandas()
    assert len(found) == docs.count()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_models_are_distributions():
    text = "abracadabra banana bandana"
    codes, counts = np.unique(langid.grams(langid.symbols(text)), return_counts=True)
    model = langid.Model(codes, counts)
    context = int(codes[0]) >> 8
    every = np.array([(context << 8) | c for c in range(256)], dtype=np.uint32)
    assert model.probability(every).sum() == pytest.approx(1.0, abs=1e-6)


def test_language_models_keep_every_gram(spark):
    rng = np.random.default_rng(3)
    # Chinese of 300,000 random letters has more than 200,000 different 4-grams, nearly all of them once
    rows = [("zh", "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 3000)))) for _ in range(100)]
    rows += [(x, "".join(rng.choice(list(letters), 3000))) for x, letters in (("en", "etaoin shrdlu"), ("de", "enisra tdhulc")) for _ in range(20)]
    rows += [("en", "enisra " * 400 + "etaoin shrdlu " * 300)] * 3  # the first 2,000 letters are like de
    learn = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    whole = {}
    for lang in ("de", "en", "zh"):
        codes, n = np.unique(np.concatenate([langid.grams(langid.symbols(t)) for x, t in rows if x == lang]), return_counts=True)
        whole[lang] = langid.Model(codes, n)
    assert len(whole["zh"].tables[3][0]) > 200_000

    def entropy(text):
        codes, n = np.unique(langid.grams(langid.symbols(text)), return_counts=True)
        return np.array([-(np.log(m.probability(codes)) @ n) / n.sum() for m in whole.values()]), int(n.sum())

    texts = [rows[0][1], rows[105][1], rows[-1][1][:50], "the of and", rows[3][1][::-1], None, "12"]
    for options in ({}, {"shard_grams": 50_000}):
        model = langid.train(learn, calibration_rows=0, **options)
        assert len(model.shards) > 4 if options else len(model.shards) == 1
        found = model.entropies(texts)
        assert found[5:] == [None, None]
        for text, (e, n) in zip(texts[:5], found, strict=False):
            assert n == entropy(text)[1] and e == pytest.approx(entropy(text)[0], rel=1e-12)


def test_language_edges(spark, nothing):
    docs = spark.createDataFrame([(1, "der die das", "de"), (2, "the of and", "en"), (3, None, "en"), (4, "123 ... !", "de"), (None, "the the", None), (1, "", "de")], "doc_id long, text string, lang string")
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, F.col("doc_id") <= 2).collect()}
    assert found == {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (None, "en"), (1, "und")}
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(nothing, F.lit(True)).collect() == []


def test_calibration_finds_temperature_floor_and_cut():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(4000):
        n = int(rng.integers(4, 400))
        gap = abs(rng.normal(0, 0.3))
        p = langid.confidence(np.array([2.0, 2.0 + gap]), n, 1.0, 0.04)
        rows.append((np.array([2.0, 2.0 + gap]), n, int(rng.random() > p[0]), 1))
    scale, floor, cut = langid.calibrated(rows)
    assert 0.7 <= scale <= 1.5 and 0.02 <= floor <= 0.08
    score = np.array([langid.confidence(e, n, scale, floor).max() for e, n, _, _ in rows])
    right = np.array([int(np.argmin(e)) for e, _, _, _ in rows]) == [r[2] for r in rows]
    for low, high in ((0.5, 0.7), (0.7, 0.9), (0.9, 1.0)):  # reliable: as many are right as the scores say
        at = (score >= low) & (score <= high)
        assert abs(score[at].mean() - right[at].mean()) < 0.04
    assert right[score >= cut].mean() >= 0.97
    scale, floor, cut = langid.calibrated([(np.array([1.0, 2.0]), 100, 0, 1)] * 300)  # no mistake: nothing is rejected, nothing is certain
    assert cut == langid.confidence(np.array([1.0, 2.0]), 100, scale, floor).max() < 1
    assert langid.calibrated([]) == (1.0, 0.0, 0.0)


def kneser_ney(texts):
    """A character's probability after the three before it, by loops over plain counters."""
    seen = Counter(tuple(g) for t in texts for g in zip(*(([0] * 2 + t)[k:] for k in range(4)), strict=False))
    levels = [seen]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    off = []
    for level in levels:
        ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
        off.append(min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5)

    def p(gram):
        if not gram:
            return 1 / 256
        level, d = levels[4 - len(gram)], off[4 - len(gram)]
        after = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        below = p(gram[1:])
        return max(level[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * below if after else below

    return p


def test_models_are_interpolated_kneser_ney():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcd "), p=[0.3, 0.3, 0.2, 0.1, 0.1]) for _ in range(60)) for _ in range(6)]
    made = [langid.symbols(t) for t in texts]
    codes, n = np.unique(np.concatenate([langid.grams(s) for s in made]), return_counts=True)
    model, plain = langid.Model(codes, n), kneser_ney([s.tolist() for s in made])
    asked = np.concatenate([codes[:150], langid.grams(langid.symbols("dddd zebra cab"))])
    expected = [plain(tuple(int(c) >> s & 255 for s in (24, 16, 8, 0))) for c in asked]
    assert model.probability(asked).tolist() == pytest.approx(expected, rel=1e-9)


def test_quality_on_held_out_rows(spark):
    found = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.35


def test_quality_gradients():
    net = quality.Network(seed=1)
    rng = np.random.default_rng(0)
    texts = [quality.cut(bytes(rng.integers(97, 110, 700).astype(np.uint8))) for _ in range(3)]
    chunks, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    y, w = np.array([1, 0, 1], dtype=np.float32), np.ones(3, dtype=np.float32)

    def loss():
        p = net.probabilities(net.pooled(chunks), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net._gradients(chunks, sizes, y, w)
    for name, at in (("out", 3), ("bias", 0), ("shift", 5)):
        value, eps = getattr(net, name), 2e-3  # small, as the maximum has kinks
        value[at] += eps
        up = loss()
        value[at] -= 2 * eps
        down = loss()
        value[at] += eps
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.1, abs=2e-3), name


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        rows = quality.cut(bytes(range(256)) * (n // 256 + 1))
        assert rows.shape[1] == quality.CHUNK
        short = quality.cut(b"x" * n)
        assert (len(short) - 1) * quality.STEP + quality.CHUNK >= n


def test_toxicity_on_held_out_rows(spark):
    found = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert found[found.toxic == 1].predicted.mean() > 0.85 and found[found.toxic == 0].predicted.mean() < 0.05


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, docs, rows, nothing, module):
    label = {quality: "quality", toxicity: "toxic"}[module]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(None, 1, "x"), (21, None, "x"), (1, 1, "x")], f"doc_id long, {label} int, text string")
    found = module.classify(docs, labels, label).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert module.classify(docs, labels.limit(0), label).select("score").distinct().count() == 1
    assert module.classify(nothing, labels, label).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").cache()
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        assert after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.count() > 100
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert mixed.where("taken <= 0 or taken > 3 * size").count() == 0
    assert mixed.join(before, "doc_id", "left_anti").count() == 0


def test_pipeline_on_odd_rows(spark, docs, rows, nothing, tmp_path):
    """Nulls, empty texts, repeated ids and a clashing column go through all five stages; so does an empty table."""
    good = [r for r in rows if r[0] is not None]
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(900 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, good[0][1] or "x"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, nothing):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path)).cache()
            assert after.columns == table.columns and after.count() <= now.count(), name
            now = after
        mixed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert mixed.where("taken <= 0").count() == 0 and mixed.count() <= now.count()
