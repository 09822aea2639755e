"""Porter's stemmer as a column expression, after his paper of 1980.

A word's form has c or v for each letter; measures are counted in it. Every step reads the word and
its form of the step before, so they are bound once for each step, not written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of each step and what stands in for them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def form(word: Column) -> Column:
    """c or v for each letter; y is a vowel after a consonant."""

    def add(done: Column, i: Column) -> Column:
        letter = F.substr(word, i, F.lit(1))
        y = F.when(F.right(done, F.lit(1)) == "c", "v").otherwise("c")
        return F.concat(done, F.when(letter.isin("a", "e", "i", "o", "u"), "v").when(letter == "y", y).otherwise("c"))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.lit(""), add)


def _measure(f: Column, n: Column) -> Column:
    return F.regexp_count(F.left(f, n), F.lit("vc"))


def _short(w: Column, f: Column) -> Column:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return f.endswith("cvc") & ~w.rlike("[wxy]$")


def _double(w: Column, f: Column) -> Column:
    return f.endswith("c") & (F.right(w, F.lit(1)) == F.substr(w, F.length(w) - 1, F.lit(1)))


def _endings(rules: dict[str, str], least: int | None) -> Callable[[Column, Column], Column]:
    """The longest ending that fits is changed if what stands before it has at least that measure."""

    def step(w: Column, f: Column) -> Column:
        out = None
        for ending, other in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0])):
            n = F.length(w) - len(ending)
            new = F.concat(F.left(w, n), F.lit(other))
            if least is not None:
                ok = _measure(f, n) >= least
                if ending == "ion":
                    ok = ok & F.left(w, n).rlike("[st]$")
                new = F.when(ok, new).otherwise(w)
            out = F.when(w.endswith(ending), new) if out is None else out.when(w.endswith(ending), new)
        return out.otherwise(w)

    return step


def _past(w: Column, f: Column) -> Column:
    """-eed, -ed and -ing, and what is put back after the last two."""

    def mended(n: Column) -> Column:
        x, g = F.left(w, n), F.left(f, n)
        undone = F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(_double(x, g) & ~x.rlike("[lsz]$"), F.left(x, n - 1))
        return undone.when((_measure(g, n) == 1) & _short(x, g), F.concat(x, F.lit("e"))).otherwise(x)

    def cut(ending: str) -> Column:
        n = F.length(w) - len(ending)
        return F.when(F.left(f, n).contains("v"), mended(n)).otherwise(w)

    shorter = F.left(w, F.length(w) - 1)
    return F.when(w.endswith("eed"), F.when(_measure(f, F.length(w) - 3) > 0, shorter).otherwise(w)).when(w.endswith("ed"), cut("ed")).when(w.endswith("ing"), cut("ing")).otherwise(w)


def _final_y(w: Column, f: Column) -> Column:
    n = F.length(w) - 1
    return F.when(w.endswith("y") & F.left(f, n).contains("v"), F.concat(F.left(w, n), F.lit("i"))).otherwise(w)


def _final_e(w: Column, f: Column) -> Column:
    n = F.length(w) - 1
    m = _measure(f, n)
    return F.when(w.endswith("e") & ((m > 1) | ((m == 1) & ~_short(F.left(w, n), F.left(f, n)))), F.left(w, n)).otherwise(w)


def _final_ll(w: Column, f: Column) -> Column:
    return F.when(w.endswith("ll") & (_measure(f, F.length(w)) > 1), F.left(w, F.length(w) - 1)).otherwise(w)


STEPS = (_endings(PLURALS, None), _past, _final_y, _endings(STEP_2, 1), _endings(STEP_3, 1), _endings(dict.fromkeys(STEP_4, ""), 2), _final_e, _final_ll)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of two letters, and those with other letters than a to z, stay."""

    def taken(step: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        return lambda w: _let(form(w), lambda f: step(w, f))

    done = word
    for step in STEPS:
        done = _let(done, taken(step))
    return F.when(word.rlike("^[a-z]{3,}$"), done).otherwise(word)
