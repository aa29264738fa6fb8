"""Perplexity of documents under a model of their own corpus, with bands for each language.

Method: modified Kneser-Ney smoothing of word trigrams, counted by Spark. Words are 64-bit hashes, a trigram's
entry is one more hash with its log probability, and the model is a table sorted by that hash, against which the
documents' sorted hashes are merged. The model covers the corpus it judges, so every trigram that is asked for has
an entry. Bands are quantiles of the log perplexity within a language; a text above or below them is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import lookup
from ..session import durable
from .arrow_text import slices, strings

# Scripts without spaces count by character, all others by word.
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿ก-๛]|(?:[^\W_぀-ヿ㐀-鿿ก-๛]|[ऀ-ॿ])+")
_BEGIN, _END = 1, 2
_hashes: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    out = []
    for w in _TOKEN.findall(text.lower()):
        if w not in _hashes:
            if len(_hashes) > 500_000:
                _hashes.clear()
            _hashes[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(_hashes[w])
    return np.array(out, np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, second and third word of every trigram, with two marks before the text and one behind it."""
    w = np.concatenate([np.full(2, _BEGIN, np.uint64), word_hashes(text), np.full(1, _END, np.uint64)])
    return w[:-2], w[1:-1], w[2:]


def _emit(per_text: bool):
    """Either lang, a, b, c, n (summed by batch) or key, lang, h, n (summed by text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                langs = batch.column(0).to_pylist()
                texts = strings(batch.column(1))
                if per_text:
                    hashes, owners, counts = [], [], []
                    for i, text in enumerate(texts):
                        a, b, c = _trigrams(text)
                        h, n = np.unique(_mix(_mix(a, b), c), return_counts=True)
                        hashes.append(h), counts.append(n), owners.append(np.full(len(h), i))
                    at = pa.array(np.concatenate(owners))
                    cols = [batch.column(2).take(at), pa.array(langs, pa.string()).take(at), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "lang", "h", "n"])
                    continue
                for lang in set(langs):
                    parts = [_trigrams(t) for t, g in zip(texts, langs) if g == lang]
                    abc = np.stack([np.concatenate([p[k] for p in parts]) for k in range(3)])
                    order = np.lexsort(abc[::-1])
                    abc = abc[:, order]
                    new = np.ones(abc.shape[1], bool)
                    new[1:] = (abc[:, 1:] != abc[:, :-1]).any(axis=0)
                    begins = np.flatnonzero(new)
                    n = np.diff([*begins, abc.shape[1]])
                    a, b, c = abc[:, begins]
                    cols = [pa.array([lang] * len(begins)), *(pa.array(x.view(np.int64)) for x in (a, b, c, _mix(_mix(a, b), c))), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "c", "h", "n"])

    return run


def _discount(n: str) -> Column:
    return F.when(F.col(n) == 1, F.col("_d1")).when(F.col(n) == 2, F.col("_d2")).otherwise(F.col("_d3"))


def _discounts(counts: DataFrame, n: str) -> DataFrame:
    """lang, _d1, _d2, _d3: the three discounts from how many entries have count 1 to 4; bounded by the languages."""
    of = [F.sum(F.when(F.col(n) == k, 1).otherwise(0)).alias(f"_n{k}") for k in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(F.col("_n1"), F.col("_n1") + 2 * F.col("_n2")), F.lit(0.5))
    d = [F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"_n{k + 1}"), F.col(f"_n{k}")), F.lit(0.5 * k)), F.lit(0.05)), F.lit(0.95 * k)).alias(f"_d{k}") for k in (1, 2, 3)]
    return counts.groupBy("lang").agg(*of).select("lang", *d)


def _context(counts: DataFrame, keys: list[str], n: str, suffix: str) -> DataFrame:
    """Of each context: the sum of its counts, the weight left for the lower order, and its number of entries."""
    left = _discount(n)
    return counts.groupBy(*keys).agg(F.sum(n).alias(f"_sum{suffix}"), F.sum(left).alias(f"_left{suffix}"), F.count(F.lit(1)).alias("_entries"))


def train(texts: DataFrame) -> DataFrame:
    """lang, h, n, log_p, sorted by h: occurrences and log probability of every trigram of ``texts`` (lang, text, key)."""
    tri = texts.mapInArrow(_emit(False), "lang string, a bigint, b bigint, c bigint, h bigint, n bigint").groupBy("lang", "a", "b", "c", "h").agg(F.sum("n").alias("n"))
    tri = durable(tri)
    bi = durable(tri.groupBy("lang", "b", "c").agg(F.count(F.lit(1)).alias("n")))
    uni = bi.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    with_d = lambda df: df.join(F.broadcast(_discounts(df, "n")), "lang")  # noqa: E731  one row a language
    tri, bi, uni = with_d(tri), with_d(bi), with_d(uni)
    total = uni.groupBy("lang").agg(F.sum("n").alias("_sum"), F.sum(_discount("n")).alias("_left"), F.count(F.lit(1)).alias("_words"))
    p1 = uni.join(F.broadcast(total), "lang").select("lang", "c", ((F.col("n") - _discount("n") + F.col("_left") / F.col("_words")) / F.col("_sum")).alias("p1"), F.col("n").alias("_k"))
    p2 = lookup(bi, _context(bi, ["lang", "b"], "n", ""), ["lang", "b"], "_entries").select("lang", "b", "c", ((F.col("n") - _discount("n")) / F.col("_sum")).alias("_own"), (F.col("_left") / F.col("_sum")).alias("_back"), F.col("n").alias("_k2"))
    p2 = lookup(p2, p1, ["lang", "c"], "_k").select("lang", "b", "c", (F.col("_own") + F.col("_back") * F.col("p1")).alias("p2"), F.col("_k2").alias("_k"))
    p3 = lookup(tri, _context(tri, ["lang", "a", "b"], "n", ""), ["lang", "a", "b"], "_entries").select("lang", "b", "c", "h", "n", ((F.col("n") - _discount("n")) / F.col("_sum")).alias("_own"), (F.col("_left") / F.col("_sum")).alias("_back"))
    p3 = lookup(p3, p2, ["lang", "b", "c"], "_k").select("lang", "h", "n", F.log(F.col("_own") + F.col("_back") * F.col("p2")).alias("log_p"))
    return durable(p3.repartitionByRange("lang", "h").sortWithinPartitions("lang", "h"))


def language(lang: Column) -> Column:
    """The first two letters of a language's spelling in lower case; und where there are none."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^[a-z]{2}", 0)
    return F.when(code != "", code).otherwise("und")


def document_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``id_col``, lang, n_words, perplexity, band: one row for every row of ``docs``.

    band is ``low`` or ``high`` where the perplexity lies outside the language's quantiles ``low`` and ``high``, else
    ``kept``. Null and wordless texts have 0 words, a null perplexity and the band ``none``. Equal texts in one
    language have equal results. Null and repeated ids stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("_id"), language(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    texts = rows.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("lang", "text", "key")
    model = train(texts)
    asked = texts.dropDuplicates(["lang", "key"]).mapInArrow(_emit(True), "key binary, lang string, h bigint, n bigint")
    # No more texts ask for a trigram than it has occurrences.
    judged = lookup(asked, model.withColumnRenamed("n", "_most"), ["lang", "h"], "_most").groupBy("lang", "key").agg(F.sum("n").alias("_tokens"), F.sum(F.col("n") * F.col("log_p")).alias("_sum"))
    judged = durable(judged.select("lang", "key", (F.col("_tokens") - 1).alias("n_words"), (-F.col("_sum") / F.col("_tokens")).alias("_log")))
    # What judged holds is one row a text; the quantiles are one row a language.
    bands = judged.groupBy("lang").agg(F.percentile_approx("_log", F.array(F.lit(low), F.lit(high)), 10_000).alias("_q"))
    judged = judged.join(F.broadcast(bands), "lang").withColumn("band", F.when(F.col("_log") < F.col("_q")[0], "low").when(F.col("_log") > F.col("_q")[1], "high").otherwise("kept"))
    out = rows.drop("text").join(judged, ["lang", "key"], "left")
    return out.select(F.col("_id").alias(id_col), "lang", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.round(F.exp("_log"), 6).alias("perplexity"), F.coalesce("band", F.lit("none")).alias("band"))
