import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import porter
from quillgraph.operators import search

PAIRS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "is": "is", "naïve": "naïve", "x1s": "x1s",
}


def vowels(w):
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def plain(w):
    """The same stemmer in plain Python."""
    if not re.fullmatch("[a-z]{3,}", w):
        return w
    m = lambda x: vowels(x).count("vc")
    short = lambda x: vowels(x).endswith("cvc") and x[-1] not in "wxy"
    double = lambda x: len(x) > 1 and x[-1] == x[-2] and vowels(x)[-1] == "c"

    def ending(w, rules, least, also=lambda e, x: True):
        for e in sorted(rules, key=len, reverse=True):
            if w.endswith(e):
                x = w[: len(w) - len(e)]
                return x + rules[e] if m(x) >= least and also(e, x) else w
        return w

    w = ending(w, porter.PLURALS, 0)
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e):
                x = w[: len(w) - len(e)]
                if "v" in vowels(x):
                    w = x + "e" if x.endswith(("at", "bl", "iz")) else x[:-1] if double(x) and x[-1] not in "lsz" else x + "e" if m(x) == 1 and short(x) else x
                break
    if w.endswith("y") and "v" in vowels(w[:-1]):
        w = w[:-1] + "i"
    w = ending(w, porter.STEP_2, 1)
    w = ending(w, porter.STEP_3, 1)
    w = ending(w, dict.fromkeys(porter.STEP_4, ""), 2, lambda e, x: e != "ion" or x[-1:] in ("s", "t"))
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


def test_known_stems(spark):
    got = spark.createDataFrame([(w,) for w in PAIRS], "w string").select("w", porter.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in got.collect()} == PAIRS == {w: plain(w) for w in PAIRS}


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_all_words(spark, table):
    words = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select(F.explode(search.tokens(F.col("text"))).alias("w")).distinct()
    odd = spark.createDataFrame([("yyyyy",), ("ayyed",), ("sses",), ("ing",), ("eed",), ("ied",), ("ion",), ("sion",), ("ll",), ("bly",)], "w string")
    for r in words.unionByName(odd).select("w", porter.stem(F.col("w")).alias("s")).collect():
        assert r.s == plain(r.w)
