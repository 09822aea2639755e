import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, answer string"


def make_rows():
    """Texts with exact and near copies, shared passages, nulls, ties, repeats and odd spacing."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "The", "of"]
    passage = " ".join(rng.choice(words) for _ in range(90))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(30)]
    texts += [texts[3], texts[3], texts[5] + " " + passage, passage + "\n" + texts[6], "x " * 40, "x\t" * 40, "\n", "", None, "a" * 3000, "One\u00a0two"]
    base = [rng.choice(words) for _ in range(160)]
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(160)] = f"z{rng.randint(0, 9)}"
        texts.append(" ".join(near))
    rows = [(i, t, ("en", "de")[i % 2], (None if i % 11 == 0 else f"s{i % 3}"), len(t or ""), "clash") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None), (None, None, None, None, None, None), (4, texts[8], "en", "s1", 1, None), (4, texts[4], "en", "s1", 1, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
