"""Queries that write tables as the files of a format into the shared folder and give what the format's reader makes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..session import checkpoint_folder
from ..sources import readers, sinks
from .tables import r6, scores, sql6, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("topic IS NOT NULL AND text IS NOT NULL").select("topic", "doc", "text")


def _written(df: DataFrame, name: str) -> str:
    """Where the lines of ``value`` were written."""
    path = _folder(df.sparkSession, name)
    df.write.text(path)
    return path


def _topic_lines(spark: SparkSession, folder: str) -> str:
    """A line a document and a line a gold phrase of a whole topic: {topic: {documents: {doc: text}, keyphrases: [[phrase]]}}."""
    kind = "struct<documents:map<string,string>,keyphrases:array<array<string>>>"
    docs = _texts(spark, folder).select("topic", F.struct(F.create_map("doc", "text").alias("documents"), F.array().cast("array<array<string>>").alias("keyphrases")).cast(kind).alias("t"))
    phrases = table(spark, folder, "gold").filter("topic IS NOT NULL AND phrase IS NOT NULL").select("topic", F.struct(F.create_map().cast("map<string,string>").alias("documents"), F.array(F.array("phrase")).alias("keyphrases")).cast(kind).alias("t"))
    return _written(docs.unionByName(phrases).select(F.to_json(F.create_map("topic", "t")).alias("value")), "topics")


def read_topic_json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a topic collection."""
    found = readers.load(spark, "topic_json", _topic_lines(spark, folder), lines=True).documents
    return found.select("topic", "doc", F.md5("text").alias("text"))


def read_topic_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold phrases of a topic collection."""
    return readers.load(spark, "topic_json", _topic_lines(spark, folder), lines=True).gold.select("topic", "cluster", "variant_pos", "phrase")


def read_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a collection of lines {name, abstract, fulltext, keywords}."""
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select(F.to_json(F.struct(F.col("doc").alias("name"), F.col("topic").alias("abstract"), F.col("text").alias("fulltext"), F.lit("a;B c").alias("keywords"))).alias("value"))
    return readers.load(spark, "json_lines", _written(rows, "lines")).documents.select("doc", F.md5("text").alias("text"))


def read_json_lines_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold of such a collection, whose keywords are the document's candidates."""
    by_doc = table(spark, folder, "candidates").filter("doc IS NOT NULL AND candidate IS NOT NULL").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("candidate")), ";").alias("keywords"))
    rows = by_doc.select(F.to_json(F.struct(F.col("doc").alias("name"), F.lit("").alias("abstract"), F.lit("").alias("fulltext"), "keywords")).alias("value"))
    return readers.load(spark, "json_lines", _written(rows, "lines")).gold.select("doc", "phrase").distinct()


def read_parquet_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have gold of their own, from a collection of two tables."""
    docs, gold = _folder(spark, "documents"), _folder(spark, "gold")
    table(spark, folder, "documents").select("topic", "doc", "text", "lang").write.parquet(docs)
    table(spark, folder, "gold").select("topic", "doc", F.col("cluster_no").alias("cluster"), "variant_pos", "phrase").write.parquet(gold)
    return readers.load(spark, "parquet", docs, gold).aligned().documents.select("topic", "doc")


def read_first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred documents by name."""
    docs = table(spark, folder, "documents").select("topic", "doc", "text", "lang")
    gold = table(spark, folder, "gold").select("topic", "doc", F.col("cluster_no").alias("cluster"), "variant_pos", "phrase")
    return readers.Collection(docs, gold).first(100).documents.select("topic", "doc")


def _entries(x: str) -> str:
    return f"concat('[{{''word'': ''a'', ''geo'': {{''lat'': ''', CAST(y AS {x}), ''', ''lon'': ''', CAST(x AS {x}), '''}}}}, {{''word'': ''b'', ''geo'': None}}]')"


def read_geoparse(spark: SparkSession, folder: str) -> DataFrame:
    """Places of documents from a geoparser's entries, a line a document."""
    rows = table(spark, folder, "topic_doc_coordinates").filter("topic_id IS NOT NULL AND doc IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    lines = rows.select(F.to_json(F.create_map("topic_id", F.create_map("doc", F.expr(_entries("STRING"))))).alias("value"))
    return readers.geoparse_json(spark, _written(lines, "geoparse"), lines=True).select("topic", "doc", r6("lat").alias("lat"), r6("lon").alias("lon")).distinct()


def read_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """The names of places that documents mention, by a table of names of up to three words."""
    names = table(spark, folder, "topic_doc_coordinates").filter("location IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select(F.trim("location").alias("name"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    return readers.gazetteer(_texts(spark, folder), names).select("topic", "doc", "name")


def read_topic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Scores written as a cache of runs by topic, and read again."""
    path = _folder(spark, "runs")
    sinks.by_topic(scores(spark, folder).filter("topic IS NOT NULL"), path)
    return readers.topic_runs(spark, path).groupBy(F.col("topic").cast("string").alias("topic")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("score")).alias("most"))


def melted_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of results, a column each, as rows."""
    columns = ["semantic_score", "moran_i", "getisord_g"]
    wide = table(spark, folder, "results").select("result_id", "loaded_at", *(finite(c).alias(c) for c in columns))
    return readers.melted(wide, ["result_id", "loaded_at"], columns)


def read_similarity_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of phrases with a similarity from 0 to 1."""
    clean = lambda c: F.regexp_replace(c, r"[\t\r\n]", " ")
    rows = table(spark, folder, "gold").filter("trim(phrase) <> '' AND topic IS NOT NULL").select(F.concat(F.lit("x"), clean(F.col("phrase"))).alias("sentence1"), F.col("topic").alias("sentence2"), (F.col("gold_id") % 6).alias("score"), F.lit("train").alias("split"))
    path = _folder(spark, "pairs")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = readers.similarity_pairs(spark, path)
    return found.groupBy("sentence2").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"))


_ALL = (read_topic_json, read_topic_gold, read_json_lines, read_json_lines_gold, read_parquet_aligned, read_first_documents, read_geoparse, read_gazetteer, read_topic_runs, melted_scores, read_similarity_tsv)
QUERIES = {f.__name__: f for f in _ALL}

_PAD = "replace(replace({}, '. ', ' . '), ', ', ' , ')"
ORACLES = {
    "read_topic_json": "SELECT topic, doc, md5(text) AS text FROM documents WHERE topic IS NOT NULL AND text IS NOT NULL",
    "read_topic_gold": "SELECT topic, 0 AS cluster, 0 AS variant_pos, phrase FROM gold WHERE topic IS NOT NULL AND phrase IS NOT NULL",
    "read_json_lines": f"SELECT doc, md5({_PAD.format('concat_ws(chr(32), topic, text)')}) AS text FROM documents WHERE text IS NOT NULL",
    "read_json_lines_gold": "SELECT DISTINCT doc, phrase FROM (SELECT doc, trim(unnest(string_split(lower(candidate), ';')), ' ') AS phrase FROM candidates WHERE doc IS NOT NULL) WHERE phrase <> ''",
    "read_parquet_aligned": "SELECT topic, doc FROM documents d WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc = d.doc AND g.topic IS NOT DISTINCT FROM d.topic)",
    "read_first_documents": "SELECT topic, doc FROM documents ORDER BY topic NULLS FIRST, doc LIMIT 100",
    "read_geoparse": f"SELECT DISTINCT topic_id AS topic, doc, {sql6('y')} AS lat, {sql6('x')} AS lon FROM topic_doc_coordinates WHERE topic_id IS NOT NULL AND doc IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)",
    "read_gazetteer": """WITH r AS (SELECT topic, doc, unnest(regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{M}''-]*(?: \\p{Lu}[\\p{L}\\p{M}''-]*)*')) AS run FROM documents WHERE topic IS NOT NULL AND text IS NOT NULL),
w AS (SELECT topic, doc, string_split(run, ' ') AS w FROM r), s AS (SELECT topic, doc, w, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (SELECT DISTINCT topic, doc, array_to_string(w[i:i + k - 1], ' ') AS name FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w))
SELECT topic, doc, name FROM n WHERE lower(name) IN (SELECT lower(trim(location, ' ')) FROM topic_doc_coordinates WHERE location IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)""",
    "read_topic_runs": f"SELECT topic, count(*) AS n, {sql6('max(score)')} AS most FROM (SELECT topic, doc, candidate, max(score) AS score FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL) WHERE topic IS NOT NULL GROUP BY topic",
    "melted_scores": " UNION ALL ".join(f"SELECT result_id, loaded_at, '{c}' AS candidate, {c} AS score FROM results WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in ("semantic_score", "moran_i", "getisord_g")),
    "read_similarity_tsv": f"SELECT topic AS sentence2, count(*) AS n, {sql6('sum((gold_id % 6) / 5)')} AS total FROM gold WHERE trim(phrase, ' ') <> '' AND topic IS NOT NULL GROUP BY 1",
}
