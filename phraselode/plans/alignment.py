"""Queries that align tables, and sources that stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .tables import scores, table


def dataset_align_inner(spark: SparkSession, folder: str) -> DataFrame:
    """Gold phrases of documents with the length of their document's text."""
    docs = table(spark, folder, "documents").select("topic", "doc", F.length("text").cast("bigint").alias("n"))
    return table(spark, folder, "gold").select("gold_id", "topic", "doc").join(docs, ["topic", "doc"]).select("gold_id", "doc", "n")


def refs_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have gold of their own."""
    return table(spark, folder, "documents").join(table(spark, folder, "gold").select("doc"), "doc", "left_semi").select("doc_id")


def missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of a document that have no finite score there."""
    rows = table(spark, folder, "candidates").select("topic", "doc", "candidate").filter("candidate IS NOT NULL").distinct()
    return rows.join(scores(spark, folder).select("topic", "doc", "candidate"), ["topic", "doc", "candidate"], "left_anti")


def geoparse_extract_json(spark: SparkSession, folder: str) -> DataFrame:
    """The number in each event's properties."""
    rows = table(spark, folder, "events").select("event_id", "props")
    return readers.flattened(rows, "props", "k bigint")


def run_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of the run caches that can be read, flattened."""
    rows = table(spark, folder, "topic_runs").select("run_id", "payload")
    flat = readers.flattened(rows, "payload", "dataset string, experiment string, topic string, trial int, top_n int")
    return flat.filter("dataset IS NOT NULL")


def identifier_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What identifiers the lines of the documents are, and lines made of them so that every kind occurs."""
    found = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    line = F.col("line")
    made = F.array(line, F.concat(F.lit("10.1234/"), F.md5(line)), (F.lit(100000) + F.length(line)).cast("string"), F.lit("ISSN: 1"), F.concat(F.lit("https://"), line), F.lit("doi 10.1/x"))
    lines = found.select(F.explode(made).alias("line"))
    return lines.groupBy(readers.identifier_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def incidence_sums(spark: SparkSession, folder: str) -> DataFrame:
    """N of every candidate of a topic: the sum of its row of the incidence matrix, copies of a row counting once."""
    rows = table(spark, folder, "incidence").filter("candidate IS NOT NULL AND n IS NOT NULL").distinct()
    return rows.groupBy("topic", "candidate").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (dataset_align_inner, refs_semi, missing_anti, geoparse_extract_json, run_fields, identifier_kinds, incidence_sums)}
ORACLES = {
    "dataset_align_inner": "SELECT gold_id, doc, length(text) AS n FROM gold JOIN documents USING (topic, doc)",
    "refs_semi": "SELECT doc_id FROM documents WHERE doc IN (SELECT doc FROM gold WHERE doc IS NOT NULL)",
    "missing_anti": "SELECT DISTINCT topic, doc, candidate FROM candidates c WHERE candidate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.topic = c.topic AND s.doc = c.doc AND s.candidate = c.candidate AND s.score IS NOT NULL AND NOT isnan(s.score))",
    "geoparse_extract_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "identifier_kinds": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT unnest([line, '10.1234/' || md5(line), CAST(100000 + length(line) AS VARCHAR), 'ISSN: 1', 'https://' || line, 'doi 10.1/x']) AS line FROM l)
SELECT CASE WHEN regexp_matches(line, '^10.[0-9]{4,9}[/=][-._;()/:a-zA-Z0-9]') THEN 'DOI' WHEN regexp_matches(line, '^[0-9]{6}') THEN 'PMID' WHEN starts_with(line, 'ISSN:') THEN 'ISSN' WHEN starts_with(line, 'http://') OR starts_with(line, 'https://') THEN 'Web' ELSE 'Other' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "incidence_sums": "SELECT topic, candidate, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT * FROM incidence WHERE candidate IS NOT NULL AND n IS NOT NULL) GROUP BY ALL",
}
