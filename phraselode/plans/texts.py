"""Queries on text: cleaning, tokens, candidates, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem, text, vectors
from ..operators import chunking, masking
from ..session import spread
from .tables import gold, rounded, table

Q: dict = {}
O: dict[str, str] = {}

_SPACE = text.SPACE
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _sql(x: str) -> str:
    return x.replace("'", "''")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_SPACE}+'), lambda w: w <> '')"


def _unescaped(x: str) -> str:
    return reduce(lambda y, b: f"replace({y}, '{b[0]}', '{b[1]}')", (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}")), x)


_swapped = "translate(text, ' .', '()')"


def _docs(name: str, out, sql: str) -> None:
    """A query that computes one column of every document."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "documents").select("doc_id", out(F.col("text")).alias("out"))

    Q[name] = run
    O[name] = f"SELECT doc_id, {sql} AS out FROM documents"


_docs("clean_punct", text.remove_punctuation, f"regexp_replace(text, '{_sql(text.PUNCTUATION)}', ' ', 'g')")
_docs("clean_special", text.remove_special_characters, f"regexp_replace(text, '{_sql(text.SPECIAL)}', ' ', 'g')")
_docs("clean_hyphens_dots", text.remove_hyphens_and_dots, "replace(replace(text, '-', ' '), '.', '')")
_docs("clean_line_breaks", text.remove_line_breaks, r"regexp_replace(text, '[\n\r\t]+', ' ', 'g')")
_docs("clean_whitespace", text.squeeze, f"regexp_replace(text, '{_SPACE}{{2,}}', ' ', 'g')")
_docs("stopword_filter", text.remove_stop_words, f"array_to_string(list_filter({_words('text')}, lambda w: NOT list_contains({_STOP}, w)), ' ')")
_docs("content_words", lambda t: F.array_join(text.content_words(t), " "), f"array_to_string(list_filter({_words('lower(text)')}, lambda w: NOT list_contains({_STOP}, w)), ' ')")
_docs("unescape_brackets", lambda t: F.concat_ws("|", text.unescape_brackets(t), text.unescape_brackets(F.translate(t, " .", "()")), text.unescape_brackets(reduce(lambda x, b: F.replace(x, F.lit(b[1]), F.lit(b[0])), text.BRACKETS.items(), F.translate(t, "aeiotn", "()[]{}")))), f"concat_ws('|', {_unescaped('text')}, {_unescaped(_swapped)}, translate(text, 'aeiotn', '()[]{{}}'))")
_docs("doc_truncate_words", lambda t: text.truncate_words(t, 50), f"array_to_string({_words('text')}[1:50], ' ')")
_docs("clean_document", text.clean_document, "trim(replace(replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '[ \\t\\r\\n,]+\\n', chr(10), 'g'), '(^|[^a-zA-Z0-9, \\t\\r\\n])\\n', '\\1' || chr(1), 'g'), chr(10), ' '), chr(1), chr(10)), '([ \\t\\r\\n])[ \\t\\r\\n]+', '\\1', 'g'), '[<>\\[\\]{}\\t]', ' ', 'g'), ' /p ' || chr(10), chr(10)), ' p ', chr(10)), ' ' || chr(10))")
_docs("model_text", text.normalize_for_model, f"trim(regexp_replace(regexp_replace(text, '{_sql(text.PUNCTUATION)}', ' ', 'g'), '{_SPACE}{{2,}}', ' ', 'g'), ' ')")


def clean_keywords_nostem(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct cleaned gold phrases of every topic."""
    return table(spark, folder, "gold").select("topic", text.clean_phrase(F.col("phrase")).alias("phrase")).filter(F.col("phrase").isNotNull()).distinct()


_CLEAN = f"trim(replace(regexp_replace(replace(replace(replace(replace(trim(lower(phrase), ' '), chr(10), ' '), chr(9), ''), '-', ' '), '.', ''), '{_SPACE}{{2,}}', ' ', 'g'), '''', ''), ' ')"


def standalone_punct_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates in which no punctuation mark stands by itself."""
    return table(spark, folder, "candidates").filter(~text.has_free_punctuation(F.col("candidate"))).select("cand_id")


def length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").filter(text.length_and_words(F.col("candidate"), 3, 4)).select("cand_id")


def stem_words(spark: SparkSession, folder: str) -> DataFrame:
    """The stem of every distinct word of the gold phrases."""
    words = gold(spark, folder).select(F.explode(text.words(F.col("phrase"))).alias("word")).distinct()
    return words.select("word", stem.stemmed(F.col("word")).alias("stem"))


def clean_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct cleaned and stemmed gold phrases of every topic."""
    return table(spark, folder, "gold").select("topic", text.clean_phrase(F.col("phrase"), stem.stemmed).alias("phrase")).filter(F.col("phrase").isNotNull()).distinct()


_TOKEN = _sql(chunking.TOKEN)
_SENTS = f"""s AS (SELECT topic, doc, unnest(p) AS tokens, CAST(unnest(range(len(p))) AS INTEGER) AS sent FROM (
  SELECT topic, doc, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_extract_all(x, '{_TOKEN}')), lambda t: len(t) > 0) AS p FROM documents WHERE text IS NOT NULL)),
t AS (SELECT topic, doc, sent, unnest(tokens) AS word, unnest(range(len(tokens))) AS tok FROM s),
g AS (SELECT *, CASE WHEN NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT' WHEN regexp_matches(word, '^[0-9]') THEN 'NUM' WHEN list_contains({_STOP}, lower(word)) THEN 'IN' WHEN contains(word, '-') THEN 'NOUN'
  WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'PROPN' WHEN regexp_matches(lower(word), 'ly$') THEN 'ADV' WHEN regexp_matches(lower(word), '{chunking.VERB}') THEN 'VERB' WHEN regexp_matches(lower(word), '{chunking.ADJECTIVE}') THEN 'ADJ' ELSE 'NOUN' END AS tag FROM t)"""


def _islands(partition: str, order: str) -> str:
    """Runs of nouns and adjectives in SQL: an island has the same difference between two row numbers."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) - 1 AS pos, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) - row_number() OVER (PARTITION BY {partition}, tag IN ('NOUN', 'PROPN', 'ADJ') ORDER BY {order}) AS run FROM g),
i AS (SELECT *, max(CASE WHEN tag <> 'ADJ' THEN pos END) OVER (PARTITION BY {partition}, run) AS last_noun FROM r WHERE tag IN ('NOUN', 'PROPN', 'ADJ'))"""


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.tagged(chunking.sentences(spread(table(spark, folder, "documents").select("topic", "doc", "text"))))


def token_tags(spark: SparkSession, folder: str) -> DataFrame:
    """How often each tag is given in each document."""
    return _tagged(spark, folder).select("topic", "doc", F.explode("tags").alias("tag")).groupBy("topic", "doc", "tag").agg(F.count(F.lit(1)).alias("n"))


def np_chunks_base(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.noun_phrases(_tagged(spark, folder))


def np_chunks_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.document_noun_phrases(_tagged(spark, folder))


def np_chunks_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.prompt_phrases(_tagged(spark, folder))


def np_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of every document with their mentions."""
    return chunking.candidates(chunking.noun_phrases(_tagged(spark, folder)), min_len=3, max_words=5)


def np_longest_first(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.longest_first(chunking.noun_phrases(_tagged(spark, folder)))


def np_single_words(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.with_single_words(chunking.noun_phrases(_tagged(spark, folder)))


_NO_PUNCTUATION = r"regexp_replace(candidate, '[!-/:-@\[-`{-~]', '', 'g')"
_PHRASES = "SELECT topic, doc, sent, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(word, ' ' ORDER BY pos) AS surface FROM i WHERE last_noun IS NOT NULL {more} GROUP BY topic, doc, sent, run"

O |= {
    "token_tags": f"WITH {_SENTS} SELECT topic, doc, tag, count(*) AS n FROM g GROUP BY ALL",
    "np_chunks_base": f"WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')} {_PHRASES.format(more='')}",
    "np_chunks_prompt": f"WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')} {_PHRASES.format(more='AND pos <= last_noun')}",
    "np_chunks_bridge": f"WITH {_SENTS}, {_islands('topic, doc', 'sent, tok')} SELECT topic, doc, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(word, ' ' ORDER BY pos) AS surface FROM i WHERE last_noun IS NOT NULL GROUP BY topic, doc, run",
    "np_candidates": f"""WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')}, p AS ({_PHRASES.format(more='')}), c AS (SELECT *, trim(lower(replace(replace(surface, ' - ', '-'), ' .', '.')), ' ') AS candidate FROM p)
SELECT topic, doc, candidate, list_sort(list(DISTINCT surface)) AS mentions, count(*) AS n_mentions, arg_min(sent, sent * 1000000 + start) AS first_sent, arg_min(start, sent * 1000000 + start) AS first_start FROM c WHERE length(candidate) > 3 AND len({_words('candidate')}) <= 5 GROUP BY topic, doc, candidate""",
    "np_longest_first": f"WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')}, p AS ({_PHRASES.format(more='')}) SELECT topic, doc, surface, row_number() OVER (PARTITION BY topic, doc ORDER BY length(surface) DESC, surface) AS place FROM (SELECT DISTINCT topic, doc, surface FROM p)",
    "np_single_words": f"WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')}, p AS ({_PHRASES.format(more='')}), k AS (SELECT * FROM p WHERE len({_words('surface')}) <= 7) SELECT DISTINCT topic, doc, phrase FROM (SELECT topic, doc, surface AS phrase FROM k UNION ALL SELECT topic, doc, unnest({_words('surface')}) AS phrase FROM k)",
    "clean_keywords_nostem": f"SELECT DISTINCT topic, phrase FROM (SELECT topic, {_CLEAN} AS phrase FROM gold) WHERE phrase <> ''",
    "standalone_punct_filter": f"SELECT cand_id FROM candidates WHERE len({_words('candidate')}) = len({_words(_NO_PUNCTUATION)})",
    "length_filter": f"SELECT cand_id FROM candidates WHERE length(candidate) > 3 AND len({_words('candidate')}) <= 4",
}


def hyphen_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("cand_id", chunking.join_hyphens(F.col("candidate")).alias("candidate"))


O["hyphen_join"] = r"SELECT cand_id, regexp_replace(candidate, '([\p{L}\p{N}]) - ([\p{L}\p{N}])', '\1-\2', 'g') AS candidate FROM candidates"


def phrase_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Where the words of each candidate's first mention lie among the words of its document."""
    docs = table(spark, folder, "documents").select("topic", "doc", text.words(F.lower("text")).alias("words"))
    cands = table(spark, folder, "candidates").select("cand_id", "topic", "doc", text.words(F.lower("candidate")).alias("phrase"))
    return cands.join(docs, ["topic", "doc"]).select("cand_id", F.explode(chunking.occurrences(F.col("phrase"), F.col("words"))).alias("pos"))


O["phrase_occurrences"] = f"""WITH d AS (SELECT topic, doc, {_words('lower(text)')} AS words FROM documents), c AS (SELECT cand_id, topic, doc, {_words('lower(candidate)')} AS phrase FROM candidates)
SELECT cand_id, CAST(pos - 1 AS INTEGER) AS pos FROM (SELECT cand_id, phrase, words, unnest(range(1, len(words) - len(phrase) + 2)) AS pos FROM c JOIN d USING (topic, doc) WHERE len(phrase) > 0) WHERE words[pos:pos + len(phrase) - 1] = phrase"""


def mention_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where any surface form of a candidate lies among the words of its document."""
    docs = table(spark, folder, "documents").select("topic", "doc", text.words(F.lower("text")).alias("words"))
    return chunking.mention_offsets(table(spark, folder, "candidates"), docs)


O["mention_offsets"] = f"""WITH d AS (SELECT topic, doc, {_words('lower(text)')} AS words FROM documents), c AS (SELECT DISTINCT topic, doc, candidate, {_words('lower(m)')} AS m FROM (SELECT topic, doc, candidate, unnest(mentions) AS m FROM candidates))
SELECT topic, doc, candidate, CAST(pos - 1 AS INTEGER) AS start, CAST(len(m) AS INTEGER) AS n FROM (SELECT topic, doc, candidate, m, words, unnest(range(1, len(words) - len(m) + 2)) AS pos FROM c JOIN d USING (topic, doc) WHERE len(m) > 0) WHERE words[pos:pos + len(m) - 1] = m"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("topic", "doc", F.lower("text").alias("text"))
    cands = table(spark, folder, "candidates").select("cand_id", "topic", "doc", F.lower(F.trim("candidate")).alias("candidate")).filter("length(candidate) > 2")
    return cands.join(docs, ["topic", "doc"])


def mask_all(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each document's text with all occurrences of the candidate masked."""
    return _pairs(spark, folder).select("cand_id", F.md5(masking.mask_all(F.col("text"), F.col("candidate"))).alias("masked"))


def mask_first(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("cand_id", F.md5(masking.mask_first(F.col("text"), F.col("candidate"))).alias("masked"))


def mask_each(spark: SparkSession, folder: str) -> DataFrame:
    """One masked text for each occurrence."""
    return _pairs(spark, folder).select("cand_id", F.posexplode(masking.mask_each(F.col("text"), F.col("candidate"))).alias("k", "text")).select("cand_id", "k", F.md5("text").alias("masked"))


_PAIRS = "p AS (SELECT cand_id, candidate, text FROM (SELECT cand_id, topic, doc, lower(trim(candidate, ' ')) AS candidate FROM candidates) JOIN (SELECT topic, doc, lower(text) AS text FROM documents) USING (topic, doc) WHERE length(candidate) > 2)"
O |= {
    "mask_all": f"WITH {_PAIRS} SELECT cand_id, md5(replace(text, candidate, '<mask>')) AS masked FROM p",
    "mask_first": f"WITH {_PAIRS} SELECT cand_id, md5(CASE WHEN contains(text, candidate) THEN text[:strpos(text, candidate) - 1] || '<mask>' || text[strpos(text, candidate) + length(candidate):] ELSE text END) AS masked FROM p",
    "mask_each": f"""WITH {_PAIRS}, x AS (SELECT cand_id, candidate, string_split(text, candidate) AS parts FROM p),
y AS (SELECT *, unnest(range(1, len(parts))) AS k FROM x)
SELECT cand_id, CAST(k - 1 AS INTEGER) AS k, md5(replace(array_to_string(parts[1:k], chr(2)), chr(2), candidate) || '<mask>' || replace(array_to_string(parts[k + 1:], chr(2)), chr(2), candidate)) AS masked FROM y""",
}


def mask_subset_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates' first spans that no longer span of the same document contains."""
    spans = table(spark, folder, "candidates").select("topic", "doc", "cand_id", F.col("first_start").alias("start"), F.col("first_end").alias("end"))
    return masking.uncovered_spans(spans, ["topic", "doc"], "cand_id").select("cand_id")


O["mask_subset_spans"] = """SELECT cand_id FROM candidates a WHERE first_start IS NOT NULL AND first_end IS NOT NULL AND topic IS NOT NULL AND doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candidates b WHERE a.topic = b.topic AND a.doc = b.doc AND b.first_start <= a.first_start AND b.first_end >= a.first_end AND b.first_end - b.first_start > a.first_end - a.first_start)"""


def annotated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each text with the candidate's marked occurrences."""
    return _pairs(spark, folder).select("cand_id", F.md5(text.annotate(F.col("text"), F.col("candidate"), "[KP]")).alias("annotated"))


def char_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The number of the word at the middle of each occurrence, from the mean word length."""
    at = F.explode(chunking.character_offsets(F.col("text"), F.col("candidate")))
    return _pairs(spark, folder).withColumn("pos", at).select("cand_id", "pos", chunking.word_index(F.col("text"), F.col("pos"), F.col("candidate")).cast("bigint").alias("word_at"))


O["annotated_texts"] = rf"WITH {_PAIRS} SELECT cand_id, md5(regexp_replace(text, '(?i)' || regexp_replace(candidate, '([\\\[\](){{}}.*+?^$|])', '\\\1', 'g') || '(?:$|([^\p{{L}}\p{{N}}]))', '[KP]\1', 'g')) AS annotated FROM p"
O["char_positions"] = f"""WITH {_PAIRS}, x AS (SELECT cand_id, candidate, text, string_split(text, candidate) AS parts, len(string_split_regex(trim(text, ' '), '\\s+')) AS n FROM p),
y AS (SELECT *, unnest(range(1, len(parts))) AS k FROM x), z AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda a: length(a))) + (k - 1) * length(candidate) AS INTEGER) AS pos FROM y)
SELECT cand_id, pos, CAST(floor((pos + length(candidate) / 2) / (length(text) / n)) AS BIGINT) AS word_at FROM z"""

def np_compat_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of phrases as two running sums of tokens."""
    sents = _tagged(spark, folder)
    found = chunking.compatible_starts(sents, chunking.noun_phrases(sents))
    return found.select("topic", "doc", "sent", "start", "compat_start")


O["np_compat_starts"] = f"""WITH {_SENTS}, {_islands('topic, doc, sent', 'tok')}, p AS ({_PHRASES.format(more='')}), l AS (SELECT topic, doc, sent, sum(len(tokens)) OVER (PARTITION BY topic, doc ORDER BY sent) AS upto FROM s)
SELECT p.topic, p.doc, p.sent, p.start, CAST(upto + coalesce(sum(n_tokens) OVER (PARTITION BY p.topic, p.doc ORDER BY p.sent, p.start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS compat_start FROM p JOIN l ON p.topic = l.topic AND p.doc = l.doc AND p.sent = l.sent"""


def lemmatized(spark: SparkSession, folder: str) -> DataFrame:
    """Gold phrases with their words replaced by a table's entries: here each word of a candidate without its last s."""
    words_ = table(spark, folder, "candidates").select(F.explode(text.words(F.lower("candidate"))).alias("word")).filter("word LIKE '%s' AND length(word) > 3").distinct()
    entries = words_.withColumn("lemma", F.expr("substring(word, 1, length(word) - 1)"))
    rows = table(spark, folder, "gold").select("gold_id", F.regexp_replace("phrase", "[^a-zA-Z ]", "").alias("phrase")).filter("trim(phrase) <> ''")
    return stem.replace_words(rows, "phrase", entries)


O["lemmatized"] = f"""WITH e AS (SELECT DISTINCT unnest({_words('lower(candidate)')}) AS word FROM candidates), l AS (SELECT word FROM e WHERE word LIKE '%s' AND length(word) > 3),
g AS (SELECT gold_id, regexp_replace(phrase, '[^a-zA-Z ]', '', 'g') AS phrase FROM gold), w AS (SELECT gold_id, unnest(string_split_regex(lower(trim(phrase, ' ')), ' +')) AS w, generate_subscripts(string_split_regex(lower(trim(phrase, ' ')), ' +'), 1) AS k FROM g WHERE trim(phrase, ' ') <> '')
SELECT gold_id, string_agg(CASE WHEN word IS NOT NULL THEN w[:length(w) - 1] ELSE w END, ' ' ORDER BY k) AS phrase FROM w LEFT JOIN l ON w = word GROUP BY gold_id"""


def pooled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a group's embeddings as tokens, pooled by mean and by maximum where a mask says so."""
    rows = table(spark, folder, "embeddings").select("label", (F.col("vec_id") % 97).alias("part"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    groups = rows.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vec"))).alias("t"))
    tokens, mask = F.transform("t", lambda x: x["vec"]), F.transform("t", lambda x: (x["vec_id"] % 3 > 0).cast("double"))
    out = groups.select("label", "part", vectors.pooled(tokens, mask).alias("mean"), vectors.pooled(tokens, mask, "max").alias("most"))
    return out.select("label", "part", rounded(F.col("mean")[0], 6).alias("mean0"), rounded(F.col("mean")[3], 6).alias("mean3"), rounded(F.col("most")[0], 6).alias("most0"), rounded(F.col("most")[3], 6).alias("most3"))


_POOL = "{f}(CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[{d}] AS DOUBLE) END)"
O["pooled_tokens"] = "SELECT label, vec_id % 97 AS part, " + ", ".join([*(f"round(coalesce({_POOL.format(f='avg', d=d + 1)}, 0), 6) + 0.0 AS mean{d}" for d in (0, 3)), *(f"round(coalesce({_POOL.format(f='max', d=d + 1)}, -1e9), 6) + 0.0 AS most{d}" for d in (0, 3))]) + " FROM embeddings GROUP BY 1, 2"


def runs_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by the day they were saved, with the stamp of the last and the days it took to load them."""
    rows = table(spark, folder, "topic_runs").filter("saved_at IS NOT NULL")
    late = F.datediff("loaded_at", "saved_at")
    return rows.groupBy(F.to_date("saved_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("saved_at"), "yyyy_MM_dd_HH_mm").alias("last_run"), F.max(late).cast("bigint").alias("most_days_late"))


O["runs_by_day"] = "SELECT CAST(saved_at AS DATE) AS day, count(*) AS n, strftime(max(saved_at), '%Y_%m_%d_%H_%M') AS last_run, max(date_diff('day', saved_at, loaded_at)) AS most_days_late FROM topic_runs WHERE saved_at IS NOT NULL GROUP BY 1"

for _f in (np_compat_starts, lemmatized, pooled_tokens, runs_by_day, clean_keywords_nostem, standalone_punct_filter, length_filter, stem_words, clean_keywords, token_tags, np_chunks_base, np_chunks_bridge, np_chunks_prompt, np_candidates, np_longest_first, np_single_words, mention_offsets, hyphen_join, phrase_occurrences, mask_all, mask_first, mask_each, mask_subset_spans, annotated_texts, char_positions):
    Q[_f.__name__] = _f

QUERIES, ORACLES = Q, O
