"""Readers of keyphrase collections. Each gives documents (topic or null, doc, text) and gold (topic, doc, cluster, variant_pos, phrase)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_document
from ..schema import DOCUMENTS, GOLD


@dataclass(frozen=True)
class Collection:
    documents: DataFrame
    gold: DataFrame

    def aligned(self) -> Collection:
        """Only documents with gold of their own, and gold of documents that are there. Documents are known by topic and
        doc, a null topic being one like any other. Gold of whole topics goes, as it belongs to no document."""
        same = lambda a, b: (F.col(f"{a}.doc") == F.col(f"{b}.doc")) & F.col(f"{a}.topic").eqNullSafe(F.col(f"{b}.topic"))
        docs = self.documents.alias("d").join(self.gold.filter("doc IS NOT NULL").select("topic", "doc").distinct().alias("g"), same("d", "g"), "left_semi")
        gold = self.gold.alias("g").join(self.documents.select("topic", "doc").alias("d"), same("g", "d"), "left_semi")
        return Collection(docs, gold)

    def first(self, n: int) -> Collection:
        """The first ``n`` documents by name, all for -1."""
        if n < 0:
            return self
        docs = self.documents.orderBy("topic", "doc").limit(n)
        own = F.col("g.topic").eqNullSafe(F.col("d.topic")) & (F.col("g.doc") == F.col("d.doc"))
        return Collection(docs, self.gold.alias("g").join(docs.select("topic", "doc").alias("d"), own, "left_semi"))

    def only(self, doc: str) -> Collection:
        return Collection(self.documents.filter(F.col("doc") == doc), self.gold.filter(F.col("doc") == doc))


def _documents(rows: DataFrame, lang: str | None = None, topic: Column | None = None) -> DataFrame:
    return rows.select((topic if topic is not None else F.lit(None).cast("string")).alias("topic"), "doc", "text", F.lit(lang).cast("string").alias("lang"))


def _gold(rows: DataFrame, phrases: Column) -> DataFrame:
    """One row for each element of an array of phrases; empty ones are left out."""
    each = rows.select("doc", F.posexplode(phrases).alias("cluster", "phrase")).withColumn("phrase", F.trim("phrase")).filter("phrase <> ''")
    return each.select(F.lit(None).cast("string").alias("topic"), "doc", "cluster", F.lit(0).alias("variant_pos"), "phrase")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """doc (the name without its ending), text of whole files."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc"), F.col("value").alias("text"))


def topic_json(spark: SparkSession, path: str, most_variants: int | None = None, lines: bool = False) -> Collection:
    """{topic: {documents: {doc: text}, keyphrases: [[variant, ...], ...]}}; the gold belongs to the topic.

    A file is one object, or with ``lines`` each of its lines is one; a topic may come several times.
    ``most_variants`` keeps so many variants of a topic, counted through its clusters.
    """
    schema = "map<string, struct<documents: map<string, string>, keyphrases: array<array<string>>>>"
    whole = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", schema)).alias("topic", "t"))
    docs = whole.select("topic", F.explode("t.documents").alias("doc", "text"))
    gold = whole.select("topic", F.posexplode("t.keyphrases").alias("cluster", "v")).select("topic", F.lit(None).cast("string").alias("doc"), "cluster", F.posexplode("v").alias("variant_pos", "phrase"))
    if most_variants is not None:
        from pyspark.sql import Window

        at = F.row_number().over(Window.partitionBy("topic").orderBy("cluster", "variant_pos"))
        gold = gold.withColumn("_k", at).filter(F.col("_k") <= most_variants).drop("_k")
    return Collection(_documents(docs, topic=F.col("topic")), gold)


def zipped(spark: SparkSession, path: str, lang: str | None = None) -> Collection:
    """Archives of docsutf8/<id>.txt and keys/<id>.key with a phrase a line; a key's document may be missing and is skipped."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith((".txt", ".key")):
                            doc = name.rpartition("/")[2].rpartition(".")[0]
                            yield pa.RecordBatch.from_pydict({"kind": [name[-3:]], "doc": [doc], "text": [z.read(name).decode("utf-8", "replace")]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "kind string, doc string, text string")
    return Collection(_documents(rows.filter("kind = 'txt'"), lang), _gold(rows.filter("kind = 'key'"), F.split("text", r"\r?\n"))).aligned()


def xml_words(spark: SparkSession, path: str, references: str, lang: str | None = None) -> Collection:
    """XML files with <word> elements, joined by spaces, and a JSON file {doc: [[variant, ...], ...]}; a file without references is an error."""
    docs = _files(spark, path, "*.xml").select("doc", F.concat(F.array_join(F.xpath("text", F.lit("//word/text()")), " "), F.lit(" ")).alias("text"))
    gold = references_json(spark, references)
    missing = docs.join(gold, "doc", "left_anti").select("doc").limit(1).collect()
    if missing:
        raise ValueError(f"no references for {missing[0].doc}")
    return Collection(_documents(docs, lang), gold)


def references_json(spark: SparkSession, path: str) -> DataFrame:
    """Gold from {doc: [[variant, ...], ...]}: the first variant of each cluster, trailing white space off."""
    refs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("doc", "clusters"))
    return _gold(refs, F.transform("clusters", lambda c: F.rtrim(F.get(c, F.lit(0)))))


def text_files(spark: SparkSession, path: str, references: str, lang: str | None = None) -> Collection:
    """Plain text files, those with references in a JSON file."""
    gold = references_json(spark, references)
    docs = _files(spark, path, "*.txt").join(gold.select("doc").distinct(), "doc", "left_semi")
    return Collection(_documents(docs, lang), gold)


def tagged_news(spark: SparkSession, path: str, annotations: str) -> Collection:
    """Files with a <TEXT> element, in lower case and cleaned, and lines doc@phrase;phrase; of annotations."""
    docs = _files(spark, path, "*").filter(F.col("text").contains("<TEXT>"))
    docs = docs.select("doc", clean_document(F.lower(F.regexp_extract("text", r"(?s)<TEXT>(.*?)</TEXT>", 1))).alias("text"))
    parts = F.split("value", "@")
    lines = spark.read.text(annotations).filter(F.size(parts) == 2).select(parts[0].alias("doc"), F.split(parts[1], ";").alias("p"))
    return Collection(_documents(docs, "en"), _gold(lines, F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0)))))


def abstract_pairs(spark: SparkSession, path: str) -> Collection:
    """<id>.abstr with the text and <id>.uncontr with phrases separated by semicolons, in lower case; % is dropped."""
    docs = _files(spark, path, "*.abstr").select("doc", F.replace("text", F.lit("%"), F.lit("")).alias("text"))
    keys = _files(spark, path, "*.uncontr")
    return Collection(_documents(docs, "en"), _gold(keys, F.split(F.lower(F.regexp_replace("text", r"\s+", " ")), "; "))).aligned()


def abstract_lines(spark: SparkSession, docs: str, keys: str) -> Collection:
    """<id>.txt with the text, cleaned and in lower case, and <id>.key with a phrase a line."""
    texts = _files(spark, docs, "*.txt").select("doc", clean_document(F.lower(F.replace("text", F.lit("%"), F.lit("")))).alias("text"))
    return Collection(_documents(texts, "en"), _gold(_files(spark, keys, "*.key"), F.split("text", r"\r?\n"))).aligned()


def _padded(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(". "), F.lit(" . ")), F.lit(", "), F.lit(" , "))


def json_lines(spark: SparkSession, path: str, full: bool = True) -> Collection:
    """Lines {name, abstract, fulltext, keywords: "a;b"}, or without full texts {abstract, keywords} with the line's digest as name."""
    rows = spark.read.schema("name string, abstract string, fulltext string, keywords string").json(path)
    name = F.col("name") if full else F.md5(F.concat_ws("\n", "abstract", "keywords"))
    text = F.concat_ws(" ", "abstract", "fulltext") if full else F.col("abstract")
    rows = rows.select(name.alias("doc"), _padded(text).alias("text"), F.split(F.lower("keywords"), ";").alias("k"))
    return Collection(_documents(rows, "en"), _gold(rows, F.col("k")))


def parquet(spark: SparkSession, documents: str, gold: str) -> Collection:
    return Collection(spark.read.schema(DOCUMENTS).parquet(documents), spark.read.schema(GOLD).parquet(gold))


#: Formats by name. Callers add theirs.
FORMATS: dict[str, Callable[..., Collection]] = {"topic_json": topic_json, "zip": zipped, "xml": xml_words, "text": text_files, "tagged_news": tagged_news, "abstract_pairs": abstract_pairs, "abstract_lines": abstract_lines, "json_lines": json_lines, "parquet": parquet}


def load(spark: SparkSession, kind: str, *paths: str, stem: str | None = None, **options) -> Collection:
    """A collection by the name of its format; ``stem`` is the language whose stemmer the gold phrases go through.

    Gold then has phrase, cleaned and stemmed, beside raw, as it came.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(FORMATS)}")
    found = FORMATS[kind](spark, *paths, **options)
    if stem is None:
        return found
    from ..functions.stem import stemmed
    from ..functions.text import clean_phrase

    gold = found.gold.withColumn("raw", F.col("phrase")).withColumn("phrase", clean_phrase(F.col("phrase"), lambda p: stemmed(p, stem))).filter("phrase IS NOT NULL")
    return Collection(found.documents, gold)


# Places.


def geoparse_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """topic, doc, lat, lon: the distinct points of {topic: {doc: "[{'geo': {'lat': ..., 'lon': ...}, ...}, ...]"}}, an object a file or line."""
    rows = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("topic", "d"))
    return entries_to_points(rows.select("topic", F.explode("d").alias("doc", "entries")))


def entries_to_points(rows: DataFrame) -> DataFrame:
    """topic, doc, lat, lon from texts of entries with single quotes; entries without a point are left out."""
    quoted = F.regexp_replace("entries", r"(?<!\\)'", '"')
    parsed = F.from_json(F.regexp_replace(quoted, r"\bNone\b", "null"), "array<struct<geo: struct<lat: string, lon: string>>>")
    return rows.select("topic", "doc", F.explode(parsed).alias("e")).select("topic", "doc", F.col("e.geo.lat").try_cast("double").alias("lat"), F.col("e.geo.lon").try_cast("double").alias("lon")).dropna(subset=["lat", "lon"]).distinct()


def gazetteer(docs: DataFrame, names: DataFrame, most_words: int = 3) -> DataFrame:
    """topic, doc, name, lat, lon: stretches of up to ``most_words`` capitalised words that a table of names (name, lat, lon) has.

    The table is joined on the name in lower case, whatever its size.
    """
    runs = F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}\p{M}'-]*(?: \p{Lu}[\p{L}\p{M}'-]*)*"), F.lit(0))

    def stretches(run):
        parts = F.split(run, " ")
        return F.flatten(F.transform(parts, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(parts) - i)), lambda n: F.array_join(F.slice(parts, i + 1, n), " "))))

    found = docs.select("topic", "doc", F.explode(F.array_distinct(F.flatten(F.transform(runs, stretches)))).alias("name"))
    table = names.groupBy(F.lower("name").alias("_key")).agg(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon"))
    return found.withColumn("_key", F.lower("name")).join(table, "_key").select("topic", "doc", "name", "lat", "lon")


# Runs and tables.


def topic_runs(spark: SparkSession, path: str) -> DataFrame:
    """A cache of runs by topic as partitioned Parquet; only folders topic=dNN are read."""
    return spark.read.option("basePath", path).parquet(f"{path}/topic=*")


def melted(scores: DataFrame, id_cols: list[str], candidates: list[str]) -> DataFrame:
    """A wide table of scores, a column a candidate, as rows of candidate and score; empty cells are left out."""
    return scores.unpivot(id_cols, candidates, "candidate", "score").filter("score IS NOT NULL")


def similarity_pairs(spark: SparkSession, path: str) -> DataFrame:
    """sentence1, sentence2, score (0 to 1), split from a tab-separated file, packed or not; quotes are ordinary characters."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    return rows.select("sentence1", "sentence2", (F.col("score").try_cast("double") / 5).alias("score"), "split")


# Kinds of identifiers and how a line of each begins, the first that matches counts.
_KINDS = {"DOI": r"^10.\d{4,9}[/=][-._;()/:a-zA-Z0-9]+", "PMID": r"^[0-9]{6,8}", "ISSN": r"^ISSN:", "Web": r"^https?://"}


def identifier_kind(line: Column) -> Column:
    """DOI, PMID, ISSN, Web or Other."""
    out = None
    for kind, pattern in _KINDS.items():
        out = F.when(line.rlike(pattern), kind) if out is None else out.when(line.rlike(pattern), kind)
    return out.otherwise("Other")


def flattened(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column beside the others."""
    parsed = rows.withColumn("_j", F.from_json(column, schema)).drop(column)
    return parsed.select(*[c for c in parsed.columns if c != "_j"], "_j.*")
