"""Stemming: Porter's published algorithm for English, nothing for other languages unless a stemmer is given."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOWELS = "aeiou"

# The suffixes of Porter's steps 2, 3 and 4, longest first where one ends in another.
_STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP_3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
_STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end) and "v" in _shape(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if _measure(w) == 1 and _short_end(w) else w
    return w


def _replace(w: str, pairs: list[str]) -> str:
    found = max((end for end in pairs[::2] if w.endswith(end)), key=len, default=None)
    if found is None:
        return w
    stem = w[: -len(found)]
    return stem + pairs[pairs.index(found) + 1].replace("-", "") if _measure(stem) > 0 else w


def porter(word: str) -> str:
    """The stem of an English word in lower case; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP_2), _STEP_3)
    end = max((e for e in _STEP_4 if w.endswith(e)), key=len, default=None)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w) > 1 else w


#: Stemmers by language; others keep the word. Callers add theirs.
STEMMERS: dict[str, Callable[[str], str]] = {"en": porter}


def stem_phrase(phrase: str | None, language: str = "en") -> str | None:
    """Every word of a phrase stemmed, joined by spaces."""
    if phrase is None:
        return None
    stem = STEMMERS.get(language, str)
    return " ".join(stem(w) for w in phrase.split())


def stemmed(phrase: Column, language: str = "en") -> Column:
    """The stemmed phrase. Each distinct word of a batch is stemmed once."""

    @F.pandas_udf("string")
    def run(phrases: pd.Series) -> pd.Series:
        stem, known = STEMMERS.get(language, str), {}

        def of(word: str) -> str:
            if word not in known:
                known[word] = stem(word)
            return known[word]

        return phrases.map(lambda p: None if p is None else " ".join(of(w) for w in p.split()))

    return run(phrase)


def replace_words(rows: DataFrame, text: str, table: DataFrame, word: str = "word", lemma: str = "lemma") -> DataFrame:
    """Every word of ``text`` in lower case and replaced by its entry in ``table``, if it has one.

    The words are joined, not broadcast, since a dictionary grows with its language; a row whose text is null or
    empty keeps it. Rows are told apart by a number of their own, so equal rows stay apart.
    """
    from ..session import durable

    numbered = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    entries = table.groupBy(F.lower(word).alias("_word")).agg(F.min(lemma).alias("_lemma"))
    each = numbered.select("_row", F.posexplode(F.split(F.lower(F.trim(text)), r"\s+")).alias("_pos", "_word")).join(entries, "_word", "left")
    joined = each.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_lemma", "_word").alias("w")))), lambda x: x["w"]), " ").alias("_text"))
    return numbered.join(joined, "_row", "left").withColumn(text, F.coalesce("_text", text)).drop("_row", "_text")
