"""Tokens, tags and noun-phrase candidates.

Everything from a text to its candidates happens within the text's row: sentences, tokens, one letter of class for
each token, and the runs of those letters. No token is shuffled. For the three grammars a greedy leftmost match is a
whole run of nouns and adjectives that holds a noun, cut behind its last noun where adjectives may not end it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, words

#: A word, with inner apostrophes and hyphens, or a single mark.
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
ADJECTIVE = r"(?:ous|ful|able|ible|al|ic|ive|less|ern|ar|ant|ent)$"
VERB = r"(?:ing|ed|ize|ise|ify)$"


def tag(word: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """A coarse tag from the word's shape; the default where no tagger is given."""
    low = F.lower(word)
    return (
        F.when(~word.rlike(r"[\p{L}\p{N}]"), "PUNCT")
        .when(word.rlike(r"^[0-9]"), "NUM")
        .when(low.isin(*stop), "IN")
        .when(F.contains(word, F.lit("-")), "NOUN")
        .when(word.rlike(r"^\p{Lu}"), "PROPN")
        .when(low.rlike(r"ly$"), "ADV")
        .when(low.rlike(VERB), "VERB")
        .when(low.rlike(ADJECTIVE), "ADJ")
        .otherwise("NOUN")
    )


def join_hyphens(text: Column) -> Column:
    """A hyphen that stands free between two words joins them into one token, which is a noun."""
    return F.regexp_replace(text, r"([\p{L}\p{N}]) - ([\p{L}\p{N}])", "$1-$2")


def sentences(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """keys, sent (from 0), tokens: the sentences of each text that hold a token."""
    parts = F.split(F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\x01"), "\x01")
    each = docs.select(*keys, F.posexplode(F.filter(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))), lambda t: F.size(t) > 0)).alias("sent", "tokens"))
    return each


def tagged(sents: DataFrame, tagger: Callable[[Column], Column] = tag) -> DataFrame:
    """Adds tags, an array beside tokens."""
    return sents.withColumn("tags", F.transform("tokens", lambda w: tagger(w)))


def tag_with(sents: DataFrame, function: Callable[[list[list[str]]], list[list[str]]]) -> DataFrame:
    """Adds tags from a function over batches of token lists, such as a trained tagger's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tags=function([list(t) for t in batch["tokens"]]))

    return sents.mapInPandas(run, f"{sents._jdf.schema().toDDL()}, tags array<string>")


def _letters(tags: Column, adjectives: Sequence[str], nouns: Sequence[str]) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.when(t.isin(*nouns), "N").when(t.isin(*adjectives), "A").otherwise("-")), "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though the expression names it several times."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _runs(tokens: Column, letters: Column, trailing_adjectives: bool) -> Column:
    """An array of start (from 0), n and words of the phrases in one sequence of tokens."""
    return once(F.struct(tokens.alias("tokens"), letters.alias("letters")), lambda x: _runs_of(x["tokens"], x["letters"], trailing_adjectives))


def _runs_of(tokens: Column, letters: Column, trailing_adjectives: bool) -> Column:
    """Stretches of one kind in order; those of nouns and adjectives are matched, their starts are running sums of lengths."""
    pattern = r"^[NA]*N[NA]*" if trailing_adjectives else r"^[NA]*N"
    none = F.array().cast("array<struct<start: int, n: int>>")
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def step(state: Column, run: Column) -> Column:
        n = F.length(F.regexp_extract(run, pattern, 0))
        out = F.when(n > 0, F.array_append(state["out"], F.struct(state["pos"].alias("start"), n.alias("n")))).otherwise(state["out"])
        return F.struct((state["pos"] + F.length(run)).alias("pos"), out.alias("out"))

    found = F.aggregate(F.regexp_extract_all(letters, F.lit("[NA]+|-+"), F.lit(0)), start, step, lambda s: s["out"])
    return F.transform(found, lambda r: F.struct(r["start"], r["n"], F.slice(tokens, r["start"] + 1, r["n"]).alias("words")))


def noun_phrases(sents: DataFrame, keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """keys, sent, start, n_tokens, surface: phrases of nouns, names and adjectives within sentences."""
    phrases = _runs(F.col("tokens"), _letters(F.col("tags"), ["ADJ"], ["NOUN", "PROPN"]), True)
    return sents.select(*keys, "sent", F.explode(phrases).alias("p")).select(*keys, "sent", "p.start", F.col("p.n").alias("n_tokens"), F.array_join("p.words", " ").alias("surface"))


def document_noun_phrases(sents: DataFrame, keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """keys, start, n_tokens, surface: the same over all tokens of a document, across sentences; true offsets."""
    docs = sents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sent", "tokens", "tags"))).alias("s"))
    whole = docs.select(*keys, F.flatten(F.transform("s", lambda x: x["tokens"])).alias("tokens"), F.flatten(F.transform("s", lambda x: x["tags"])).alias("tags"))
    phrases = _runs(F.col("tokens"), _letters(F.col("tags"), ["ADJ"], ["NOUN", "PROPN"]), True)
    return whole.select(*keys, F.explode(phrases).alias("p")).select(*keys, "p.start", F.col("p.n").alias("n_tokens"), F.array_join("p.words", " ").alias("surface"))


def prompt_phrases(sents: DataFrame, keys: Sequence[str] = ("topic", "doc"), drop_single: bool = False) -> DataFrame:
    """keys, sent, start, n_tokens, surface: phrases that end with a noun; ``drop_single`` leaves out single words that come once.

    Stop words never belong to a phrase: the default tagger has them apart.
    """
    phrases = _runs(F.col("tokens"), _letters(F.col("tags"), ["ADJ"], ["NOUN", "PROPN"]), False)
    out = sents.select(*keys, "sent", F.explode(phrases).alias("p")).select(*keys, "sent", "p.start", F.col("p.n").alias("n_tokens"), F.array_join("p.words", " ").alias("surface"))
    if drop_single:
        often = out.groupBy(*keys, F.lower("surface").alias("_s")).agg(F.count(F.lit(1)).alias("_k"))
        out = out.withColumn("_s", F.lower("surface")).join(often, [*keys, "_s"]).filter((F.col("n_tokens") > 1) | (F.col("_k") > 1)).drop("_s", "_k")
    return out


def compatible_starts(sents: DataFrame, phrases: DataFrame, keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """``phrases`` (keys, sent, start, n_tokens) with compat_start: the tokens of all sentences up to and with the phrase's
    own, and those of the phrases before it. It grows along a document but is no offset of a token."""
    upto = Window.partitionBy(*keys).orderBy("sent")
    lengths = sents.select(*keys, "sent", F.sum(F.size("tokens")).over(upto).alias("_upto"))
    before = Window.partitionBy(*keys).orderBy("sent", "start").rowsBetween(Window.unboundedPreceding, -1)
    own = phrases.withColumn("_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return own.join(lengths, [*keys, "sent"]).withColumn("compat_start", F.col("_upto") + F.col("_before")).drop("_upto", "_before")


def candidate_form(surface: Column) -> Column:
    """A phrase in lower case with joined hyphens and stops."""
    return F.trim(F.lower(F.replace(F.replace(surface, F.lit(" - "), F.lit("-")), F.lit(" ."), F.lit("."))))


def candidates(phrases: DataFrame, keys: Sequence[str] = ("topic", "doc"), min_len: int = 0, max_words: int = 7) -> DataFrame:
    """keys, candidate, mentions, n_mentions, first_sent, first_start: one row for each phrase of a document.

    The candidate is the phrase in lower case with joined hyphens and stops; mentions is the sorted set of its surface
    forms. Phrases not longer than ``min_len`` characters or of more than ``max_words`` words are left out.
    """
    kept = phrases.withColumn("candidate", candidate_form(F.col("surface"))).filter((F.length("candidate") > min_len) & (F.size(words(F.col("candidate"))) <= max_words))
    first = F.min(F.struct("sent", "start"))
    out = kept.groupBy(*keys, "candidate").agg(F.array_sort(F.collect_set("surface")).alias("mentions"), F.count(F.lit(1)).alias("n_mentions"), first.alias("_f"))
    return out.select(*keys, "candidate", "mentions", "n_mentions", F.col("_f.sent").alias("first_sent"), F.col("_f.start").alias("first_start"))


def longest_first(phrases: DataFrame, keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """keys, surface, place: a document's distinct phrases, the longest first, equal lengths by their text."""
    unique = phrases.select(*keys, "surface").distinct()
    return unique.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length("surface")), "surface")).cast("bigint"))


def with_single_words(phrases: DataFrame, keys: Sequence[str] = ("topic", "doc"), max_words: int = 7) -> DataFrame:
    """keys, phrase: the distinct phrases of up to ``max_words`` words, and each of their words."""
    kept = phrases.filter(F.size(words(F.col("surface"))) <= max_words)
    return kept.select(*keys, F.explode(F.array_append(words(F.col("surface")), F.col("surface"))).alias("phrase")).distinct()


def mention_offsets(candidates: DataFrame, docs: DataFrame, keys: Sequence[str] = ("topic", "doc")) -> DataFrame:
    """keys, candidate, start, n: where any surface form of a candidate lies among its document's words, letter case ignored.

    ``docs`` has keys and words, an array in lower case. Forms that are alike but for case count once.
    """
    forms = candidates.select(*keys, "candidate", F.explode("mentions").alias("_m")).select(*keys, "candidate", words(F.lower("_m")).alias("_m")).distinct()
    found = forms.join(docs.select(*keys, "words"), list(keys))
    return found.select(*keys, "candidate", F.explode(occurrences(F.col("_m"), F.col("words"))).alias("start"), F.size("_m").alias("n"))


def occurrences(needle: Column, haystack: Column) -> Column:
    """All offsets (from 0) where the array ``needle`` lies in ``haystack``, overlaps included; empty for an empty needle."""
    last = F.size(haystack) - F.size(needle)
    offsets = F.when((last >= 0) & (F.size(needle) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # Most offsets fail at their first element, which costs no slice.
    return F.filter(offsets, lambda i: (F.get(haystack, i) == F.get(needle, F.lit(0))) & (F.slice(haystack, i + 1, F.size(needle)) == needle))


def character_offsets(text: Column, phrase: Column) -> Column:
    """Offsets in characters (from 0) of a phrase's occurrences that don't overlap, letter case ignored."""
    quoted = F.regexp_replace(F.lower(phrase), r"([\\\[\](){}.*+?^$|])", r"\\$1")
    none = F.array().cast("array<int>")

    def ends(parts: Column) -> Column:
        # Each part but the last is followed by the phrase: running sums of the lengths before it.
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        step = lambda s, p: F.struct((s["pos"] + F.length(p) + F.length(phrase)).alias("pos"), F.array_append(s["out"], s["pos"] + F.length(p)).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["out"])

    return F.when(F.length(phrase) > 0, once(F.split(F.lower(text), quoted), ends)).otherwise(none)


def word_index(text: Column, offset: Column, phrase: Column) -> Column:
    """The number of the word in the middle of a phrase, from the text's mean word length; the last word without an offset."""
    n = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce(F.floor((offset + F.length(phrase) / 2) / (F.length(text) / n)), n - 1)
