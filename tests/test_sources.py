import json
import pickle
import zipfile

import pytest
from phraselode import cli
from phraselode.config import Config
from phraselode.plans import pipeline
from phraselode.sources import readers, sinks
from pyspark.sql import functions as F


def docs(c):
    return {r.doc: r.text for r in c.documents.collect()}


def gold(c):
    return sorted((r.doc or r.topic, r.cluster, r.variant_pos, r.phrase) for r in c.gold.collect())


TOPICS = {"d01": {"documents": {"x": "The old rail tunnel near Oslo was closed. A rail tunnel is dark.", "y": "Storm surge and rail tunnel."}, "keyphrases": [["rail tunnel", "tunnel"], ["storm surge"]]}}


def test_topic_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(TOPICS, indent=1))
    c = readers.load(spark, "topic_json", str(tmp_path / "t.json"))
    assert docs(c)["y"] == "Storm surge and rail tunnel." and gold(c) == [("d01", 0, 0, "rail tunnel"), ("d01", 0, 1, "tunnel"), ("d01", 1, 0, "storm surge")]
    assert len(gold(readers.load(spark, "topic_json", str(tmp_path / "t.json"), most_variants=2))) == 2
    assert c.first(1).documents.count() == 1 and c.first(-1).documents.count() == 2 and c.only("y").documents.count() == 1
    with pytest.raises(ValueError):
        readers.load(spark, "nothing")


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a/docsutf8/1.txt", "text one")
        z.writestr("a/keys/1.key", "one\n\ntwo words\r\n")
        z.writestr("a/keys/2.key", "lost")
    c = readers.load(spark, "zip", str(tmp_path / "a.zip"), lang="pt")
    assert docs(c) == {"1": "text one"} and [g[3] for g in gold(c)] == ["one", "two words"]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.xml").write_text("<d><s><word>Big</word><word>storm</word></s></d>")
    (tmp_path / "refs.json").write_text(json.dumps({"1": [["big storm ", "storm"]]}))
    c = readers.load(spark, "xml", str(tmp_path / "x"), str(tmp_path / "refs.json"))
    assert docs(c) == {"1": "Big storm "} and gold(c) == [("1", 0, 0, "big storm")]
    (tmp_path / "x" / "2.xml").write_text("<d><word>x</word></d>")
    with pytest.raises(ValueError):
        readers.load(spark, "xml", str(tmp_path / "x"), str(tmp_path / "refs.json"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("plain\ntext")
    (tmp_path / "t" / "9.txt").write_text("no refs")
    assert docs(readers.load(spark, "text", str(tmp_path / "t"), str(tmp_path / "refs.json"))) == {"1": "plain\ntext"}


def test_tagged_news(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AP1").write_text("<DOC><TEXT>\nThe Storm,\n hit [land].\n</TEXT><TEXT>no</TEXT></DOC>")
    (tmp_path / "a.txt").write_text("AP1@storm;land fall;\n")
    c = readers.load(spark, "tagged_news", str(tmp_path / "d"), str(tmp_path / "a.txt"))
    assert docs(c)["AP1"].startswith("the storm") and "no" not in docs(c)["AP1"].split() and [g[3] for g in gold(c)] == ["storm", "land fall"]


def test_abstracts(spark, tmp_path):
    (tmp_path / "1.abstr").write_text("Ten % more\n\tstorms")
    (tmp_path / "1.uncontr").write_text("Storm surge; rail\n tunnel")
    c = readers.load(spark, "abstract_pairs", str(tmp_path))
    assert [g[3] for g in gold(c)] == ["storm surge", "rail tunnel"] and "%" not in docs(c)["1"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "5.txt").write_text("A Text,\nof lines")
    (tmp_path / "s" / "5.key").write_text("text\nlines")
    assert [g[3] for g in gold(readers.load(spark, "abstract_lines", str(tmp_path / "s"), str(tmp_path / "s")))] == ["text", "lines"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": "n", "abstract": "A. B", "fulltext": "c, d", "keywords": "X;y z"}\n')
    c = readers.load(spark, "json_lines", str(tmp_path / "a.jsonl"))
    assert docs(c) == {"n": "A . B c , d"} and [g[3] for g in gold(c)] == ["x", "y z"]
    assert list(docs(readers.load(spark, "json_lines", str(tmp_path / "a.jsonl"), full=False)).values()) == ["A . B"]


def test_stemmed_gold(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"t": {"documents": {"x": "y"}, "keyphrases": [["Rising-tides."]]}}))
    r = readers.load(spark, "topic_json", str(tmp_path / "t.json"), stem="en").gold.first()
    assert (r.phrase, r.raw) == ("rise tide", "Rising-tides.")


def test_geoparse(spark, tmp_path):
    entries = "[{'word': 'Oslo', 'geo': {'lat': '59.9', 'lon': '10.7'}}, {'word': 'x', 'geo': None}, {'geo': {'lat': '59.9', 'lon': '10.7'}}]"
    (tmp_path / "g.json").write_text(json.dumps({"t": {"d": entries}}))
    assert [tuple(r) for r in readers.geoparse_json(spark, str(tmp_path / "g.json")).collect()] == [("t", "d", 59.9, 10.7)]
    names = spark.createDataFrame([("Oslo", 59.9, 10.7), ("New York", 40.7, -74.0)], "name string, lat double, lon double")
    texts = spark.createDataFrame([("t", "d", "From Oslo to New York and Paris"), ("t", "e", None)], "topic string, doc string, text string")
    assert sorted(r.name for r in readers.gazetteer(texts, names).collect()) == ["New York", "Oslo"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("t1", "a", 0.5, ["x"]), ("t2", "b", None, None)], "topic string, doc string, score double, l array<string>")
    sinks.by_topic(df, str(tmp_path / "p"))
    sinks.by_topic(df.filter("topic = 't1'").withColumn("doc", F.lit("z")), str(tmp_path / "p"))
    assert sorted(r.doc for r in readers.topic_runs(spark, str(tmp_path / "p")).collect()) == ["b", "z"]
    for kind in ("csv", "json", "parquet"):
        sinks.table(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.table(df, "x", "xlsx")
    assert r"t1 & a & 0.50" in sinks.latex(df)
    with pytest.raises(ValueError):
        sinks.latex(df, 1)
    wide = spark.createDataFrame([("t", "d", 0.1, None)], "topic string, doc string, a double, b double")
    assert [tuple(r) for r in readers.melted(wide, ["topic", "doc"], ["a", "b"]).collect()] == [("t", "d", "a", 0.1)]


def test_pickle(spark, tmp_path):
    (tmp_path / "p.pkl").write_bytes(pickle.dumps([("text \\[1\\]", ["a", "b"])]))
    sinks.convert_pickle(spark, str(tmp_path / "p.pkl"), str(tmp_path / "out"))
    assert docs(readers.load(spark, "parquet", str(tmp_path / "out/documents"), str(tmp_path / "out/gold"))) == {"0": "text [1]"}
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps([print]))
    with pytest.raises(pickle.UnpicklingError):
        sinks.convert_pickle(spark, str(tmp_path / "bad.pkl"), str(tmp_path / "out"))


def test_small_readers(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('sentence1\tsentence2\tscore\tsplit\na "b\tc\t2.5\ttrain\n')
    assert tuple(readers.similarity_pairs(spark, str(tmp_path / "s.tsv")).first()) == ('a "b', "c", 0.5, "train")
    lines = spark.createDataFrame([("10.1000/xyz",), ("12345678",), ("ISSN: 1234-567X",), ("https://www.a.org",), ("doi 10.1000/xyz",)], "l string")
    assert [r[0] for r in lines.select(readers.identifier_kind(F.col("l"))).collect()] == ["DOI", "PMID", "ISSN", "Web", "Other"]


def _runs():
    """As many runs as there are rankings of topics; the other names take turns, so that each is met."""
    tables = {"extractor": pipeline.EXTRACTORS, "embedding": pipeline.EMBEDDINGS, "doc_rank": pipeline.DOC_RANKS, "mask": pipeline.MASKS}
    return [{"rank": r, **{k: list(t)[i % len(t)] for k, t in tables.items()}} for i, r in enumerate((*pipeline.TOPIC_RANKS, *pipeline.VECTOR_RANKS))]


@pytest.mark.parametrize("how", _runs(), ids=lambda how: "-".join(how.values()))
def test_pipeline(spark, tmp_path, how):
    (tmp_path / "t.json").write_text(json.dumps(TOPICS))
    spark.createDataFrame([("d01", "x", 59.9, 10.7), ("d01", "y", 60.4, 5.3)], "topic string, doc string, lat double, lon double").write.parquet(str(tmp_path / "places"))
    config = Config(format="topic_json", paths=(str(tmp_path / "t.json"),), places=str(tmp_path / "places") if how["rank"] == "mean" else None, **how)
    out = pipeline.run(spark, config)
    ranked = {r.candidate: r.score for r in out["ranking"].collect()}
    if how["rank"] in ("medoids", "components"):
        assert len(ranked) <= 4
        return
    assert "rail tunnel" in ranked or "old rail tunnel" in ranked
    assert config.places or any(s is not None for s in ranked.values())
    if how["rank"] in ("mean", "mmr"):
        assert out["metrics"].filter("k = 0").first().recall >= 0.5
    with pytest.raises(ValueError):
        pipeline.topic_scores(None, out["scores"], Config(rank="nothing"))


def test_contexts(spark):
    docs = spark.createDataFrame([("t", "d", "The rail tunnel is closed. A storm hit the rail tunnel.", "en")], "topic string, doc string, text string, lang string")
    x = pipeline.extract(docs, Config())
    spans = sorted((r.start, r.n, r.candidate) for r in x.spans().collect() if r.candidate == "rail tunnel")
    tokens = {r.tok: r.vec for r in x.token_vectors().collect()}
    assert [s[:2] for s in spans] == [(1, 2), (10, 2)] and len(tokens) == 13
    got = {r.candidate: r.vec for r in pipeline.EMBEDDINGS["in_context"](x).collect()}["rail tunnel"]
    want = [sum(tokens[s + k][i] for s, _, _ in spans for k in (0, 1)) / 4 for i in range(64)]
    assert got == pytest.approx(want)


def test_command_line():
    c = cli.parse(["--format", "zip", "--paths", "a", "b", "--top-n", "7", "--no-stem", "--alpha", "0.25"])
    assert (c.format, c.paths, c.top_n, c.stem, c.alpha) == ("zip", ("a", "b"), 7, False, 0.25)
