"""From documents to rankings, re-ranked by place and evaluated: one plan of DataFrames, its parts chosen by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import words
from ..functions.vectors import cosine, mean_vectors
from ..operators import chunking, embedding, evaluate, geo, masking, rank_doc, rank_matrix, rank_topic
from ..sources import readers

DOC = ["topic", "doc"]


# Extraction: sentences with tags, and a column of how many tokens come before, to phrases with document-wide starts.


def _placed(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("start", F.col("offset") + F.col("start")).drop("offset")


#: Extractors of phrases. Callers add theirs.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "base": lambda s: _placed(chunking.noun_phrases(s, [*DOC, "offset"])),
    "prompt": lambda s: _placed(chunking.prompt_phrases(s, [*DOC, "offset"])),
    "prompt_often": lambda s: _placed(chunking.prompt_phrases(s, [*DOC, "offset"], drop_single=True)),
    "bridge": lambda s: chunking.document_noun_phrases(s, DOC).withColumn("sent", F.lit(0)),
}


@dataclass(frozen=True)
class Extracted:
    """What a document's stages have in common."""

    documents: DataFrame
    sentences: DataFrame
    phrases: DataFrame
    candidates: DataFrame
    embedder: embedding.Embedder | None = None

    def document_vectors(self) -> DataFrame:
        return self.documents.select(*DOC, embedding.embed(F.col("text"), self.embedder).alias("vec"))

    def spans(self) -> DataFrame:
        """topic, doc, candidate, start, n: every mention's tokens."""
        return self.phrases.select(*DOC, chunking.candidate_form(F.col("surface")).alias("candidate"), "start", F.col("n_tokens").alias("n"))

    def token_vectors(self) -> DataFrame:
        """topic, doc, tok, vec: of every token with its neighbours on both sides, which stands in for a model's context."""
        tokens = self.sentences.select(*DOC, "offset", "tokens", F.posexplode("tokens").alias("pos", "_t"))
        near = F.array_join(F.slice("tokens", F.greatest(F.col("pos"), F.lit(1)), F.least(F.col("pos"), F.lit(1)) + 2), " ")
        return tokens.select(*DOC, (F.col("offset") + F.col("pos")).alias("tok"), embedding.embed(near, self.embedder).alias("vec"))


def extract(docs: DataFrame, config: Config, embedder: embedding.Embedder | None = None) -> Extracted:
    docs = docs.filter("text IS NOT NULL").withColumn("topic", F.coalesce("topic", "doc"))
    before = Window.partitionBy(*DOC).orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    sents = chunking.tagged(chunking.sentences(docs)).withColumn("offset", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)).cast("int"))
    phrases = EXTRACTORS[config.extractor](sents)
    return Extracted(docs, sents, phrases, chunking.candidates(phrases, DOC, config.min_len, config.max_words), embedder)


# Vectors of candidates: topic, doc, candidate, vec.


def _no_context(x: Extracted) -> DataFrame:
    each = x.candidates.select("candidate").distinct().select("candidate", embedding.embed(F.col("candidate"), x.embedder).alias("vec"))
    return x.candidates.select(*DOC, "candidate").join(each, "candidate").select(*DOC, "candidate", "vec")


def _in_context(x: Extracted, edges: bool = False) -> DataFrame:
    return embedding.embed_in_context(x.spans(), x.token_vectors(), DOC, _no_context(x), edges)


#: Embeddings of candidates. Callers add theirs.
EMBEDDINGS: dict[str, Callable[[Extracted], DataFrame]] = {
    "mentions": lambda x: embedding.embed_mentions(x.candidates, DOC, x.embedder),
    "no_context": _no_context,
    "in_context": _in_context,
    "in_context_edges": lambda x: _in_context(x, edges=True),
    "in_and_out": lambda x: embedding.in_and_out_of_context(_in_context(x), _no_context(x), DOC),
}


# Scores of a document's candidates: topic, doc, candidate, score.


def _cosine(x: Extracted, config: Config) -> DataFrame:
    ranked = rank_doc.embed_rank(EMBEDDINGS[config.embedding](x), x.document_vectors(), DOC, ["candidate"])
    return ranked.select(*DOC, "candidate", "score").filter("score IS NOT NULL")


def _embed(x: Extracted, config: Config) -> DataFrame:
    lengths = x.documents.select(*DOC, F.size(words(F.col("text"))).alias("doc_len"))
    placed = _cosine(x, config).join(x.candidates.select(*DOC, "candidate", "first_start"), [*DOC, "candidate"]).join(lengths, DOC)
    return placed.select(*DOC, "candidate", rank_doc.position_bias(F.col("score"), F.col("first_start"), F.col("doc_len")).alias("score")).filter("score IS NOT NULL")


#: Masked texts of a document and a candidate in lower case: one text or an array of them. Callers add theirs.
MASKS = {
    "all": lambda text, phrase: F.array(masking.mask_all(text, phrase)),
    "first": lambda text, phrase: F.array(masking.mask_first(text, phrase)),
    "highest": masking.mask_each,
}


def _masked(x: Extracted, candidates: DataFrame, mask: str) -> DataFrame:
    """1 less the smallest cosine of a masked text with its document; 0 where nothing is masked."""
    docs = x.documents.select(*DOC, F.lower("text").alias("text"))
    whole = docs.select(*DOC, embedding.embed(F.col("text"), x.embedder).alias("_doc"))
    texts = candidates.select(*DOC, "candidate").join(docs, DOC).select(*DOC, "candidate", F.explode_outer(MASKS[mask](F.col("text"), F.col("candidate"))).alias("text"))
    each = texts.withColumn("vec", embedding.embed(F.col("text"), x.embedder)).join(whole, DOC)
    return each.groupBy(*DOC, "candidate").agg(F.coalesce(rank_doc.mask_score(F.min(cosine(F.col("vec"), F.col("_doc")))), F.lit(0.0)).alias("score"))


def _mask_subset(x: Extracted, config: Config) -> DataFrame:
    """Masks only candidates with a mention that no longer phrase of the document contains; the others score 0."""
    spans = x.spans().withColumn("end", F.col("start") + F.col("n")).withColumn("_id", F.monotonically_increasing_id())
    free = masking.uncovered_spans(spans, DOC, "_id").select(*DOC, "candidate").distinct()
    own = x.candidates.select(*DOC, "candidate")
    scored = _masked(x, own.join(free, [*DOC, "candidate"], "left_semi"), "all")
    return own.join(scored, [*DOC, "candidate"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


#: Rankings of a document's candidates. Callers add theirs.
DOC_RANKS: dict[str, Callable[[Extracted, Config], DataFrame]] = {
    "embed": _embed,
    "cosine": _cosine,
    "mask": lambda x, c: _masked(x, x.candidates, c.mask),
    "mask_subset": _mask_subset,
    "extraction": lambda x, c: rank_doc.constant_scores(x.candidates.select(*DOC, "candidate"), DOC).select(*DOC, "candidate", "score"),
    "fusion_weighted": lambda x, c: rank_doc.fuse_weighted([(_cosine(x, c), 0.5), (_masked(x, x.candidates, c.mask), 0.5)], DOC),
    "fusion_harmonic": lambda x, c: rank_doc.fuse_harmonic(_cosine(x, c), _masked(x, x.candidates, c.mask), DOC),
}


def document_scores(docs: DataFrame, config: Config, embedder=None) -> DataFrame:
    """topic, doc, candidate, score by the configuration's extractor, embedding and ranking."""
    return DOC_RANKS[config.doc_rank](extract(docs, config, embedder), config)


# Rankings of a topic: topic, candidate, score.

#: From document scores. Callers add theirs.
TOPIC_RANKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mean": lambda s: rank_topic.aggregate_scores(s, "mean"),
    "max": lambda s: rank_topic.aggregate_scores(s, "max"),
    "meantopmax": rank_topic.mean_of_top_half,
    "rrf": rank_topic.reciprocal_rank_fusion,
}


def _by_place(ranked: DataFrame) -> DataFrame:
    return ranked.select("topic", "id", (1 / F.col("place")).alias("score"))


def _docs_of(x: Extracted) -> DataFrame:
    """topic, id, docs: the documents that list a candidate."""
    listed = x.candidates.select("topic", F.xxhash64("candidate").alias("id"), F.xxhash64("doc").alias("d")).distinct()
    return listed.groupBy("topic", "id").agg(F.array_sort(F.collect_list("d")).alias("docs"))


#: From the candidates' mean vectors (topic, id, vec) and what was extracted. Callers add theirs.
VECTOR_RANKS: dict[str, Callable[[DataFrame, Extracted, Config], DataFrame]] = {
    "mmr": lambda v, x, c: _by_place(rank_matrix.mmr(v, c.top_n, c.diversity)),
    "maxsum": lambda v, x, c: rank_matrix.max_sum(v, min(c.top_n, 10)),
    "medoids": lambda v, x, c: rank_matrix.cluster_medoids(v).withColumn("score", F.col("n").cast("double")),
    "components": lambda v, x, c: rank_matrix.cluster_medoids(v, 0.95, components=2).withColumn("score", F.col("n").cast("double")),
    "coranking": lambda v, x, c: rank_matrix.co_ranking(v, _docs_of(x)),
    "affinity": lambda v, x, c: rank_matrix.affinity_ranking(v),
    "eigen": lambda v, x, c: rank_matrix.eigen_centrality(v),
    "dpsc": lambda v, x, c: rank_topic.density_diversity(v),
    "cross": lambda v, x, c: rank_topic.similarity_to_documents(v, x.document_vectors().select("topic", F.xxhash64("doc").alias("id"), "vec")).withColumnRenamed("mean", "score"),
}


def _vector_ranking(x: Extracted, config: Config) -> DataFrame:
    """Candidates are known by a hash of their text."""
    vectors = mean_vectors(EMBEDDINGS[config.embedding](x), ["topic", "candidate"])
    known = vectors.withColumn("id", F.xxhash64("candidate"))
    ranked = VECTOR_RANKS[config.rank](known.select("topic", "id", "vec"), x, config)
    return ranked.select("topic", "id", "score").join(known.select("topic", "id", "candidate"), ["topic", "id"]).select("topic", "candidate", "score")


def topic_scores(x: Extracted | None, scores: DataFrame, config: Config) -> DataFrame:
    """topic, candidate, score by the name of the ranking, from document scores or from vectors."""
    if config.rank in TOPIC_RANKS:
        return TOPIC_RANKS[config.rank](scores).select("topic", "candidate", "score")
    if config.rank not in VECTOR_RANKS:
        raise ValueError(f"unknown ranking {config.rank}; there are {', '.join([*TOPIC_RANKS, *VECTOR_RANKS])}")
    return _vector_ranking(x, config)


def topic_ranking(scores: DataFrame, config: Config, x: Extracted | None = None) -> DataFrame:
    """topic, candidate, score, rank."""
    return rank_doc.top(topic_scores(x, scores, config), ["topic"], "score", ["candidate"], config.top_n)


#: Columns of the indices of spatial association by name.
INDICES = {"moran": "moran_i", "geary": "geary_c", "getis": "getisord_g"}


def geo_ranking(scores: DataFrame, places: DataFrame, config: Config, x: Extracted | None = None) -> DataFrame:
    """topic, candidate, score, rank: the topic's scores times the power of their spatial association."""
    column = INDICES[config.index]
    found = geo.association(geo.point_scores(scores, places), decay=config.decay, a=config.decay_parameter, distance=config.distance)
    both = topic_scores(x, scores, config).join(found.select("topic", "candidate", column), ["topic", "candidate"], "left")
    both = both.withColumn("score", geo.rerank_power(F.col("score"), F.col(column), config.alpha))
    return rank_doc.top(both, ["topic"], "score", ["candidate"], config.top_n)


def evaluation(ranked: DataFrame, gold: DataFrame, config: Config) -> DataFrame:
    """k, precision, recall, f1, n: means over topics; phrases are stemmed on both sides if the gold is."""
    from ..functions.stem import stemmed
    from ..functions.text import clean_phrase

    phrase = clean_phrase(F.col("candidate"), lambda p: stemmed(p, config.language)) if config.stem else F.col("candidate")
    rows = evaluate.distinct_ranking(ranked.select("topic", phrase.alias("phrase"), "rank"), ["topic"])
    hits = evaluate.with_hits(rows, gold.withColumn("topic", F.coalesce("topic", "doc")), ["topic"])
    return evaluate.mean_metrics(evaluate.by_ranking(hits, ["topic"]), ["k"])


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """The tables of a run by name."""
    found = readers.load(spark, config.format, *config.paths, stem=config.language if config.stem else None)
    found = found.only(config.doc) if config.doc else found.first(config.doc_limit)
    x = extract(found.documents, config)
    scores = DOC_RANKS[config.doc_rank](x, config)
    ranked = topic_ranking(scores, config, x)
    if config.places:
        ranked = geo_ranking(scores, spark.read.parquet(config.places), config, x)
    return {"scores": scores, "ranking": ranked, "metrics": evaluation(ranked, found.gold, config)}
