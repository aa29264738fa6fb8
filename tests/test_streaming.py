from phraselode.operators import chunking
from phraselode.schema import DOCUMENTS
from phraselode.streaming import rows


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(docs):
        spark.createDataFrame([("t", d, text, None) for d, text in docs], DOCUMENTS).write.mode("append").parquet(source)
        rows.append(rows.phrases(rows.documents(spark, source)), out, checkpoint).awaitTermination()

    arrive([("a", "The rail tunnel was closed. A storm surge came."), ("b", None)])
    arrive([("c", "Late Oslo news"), ("d", "")])
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    whole = chunking.noun_phrases(chunking.tagged(chunking.sentences(spark.read.schema(DOCUMENTS).parquet(source))))
    assert got == sorted(tuple(r) for r in whole.collect()) and {r[1] for r in got} == {"a", "c"}
