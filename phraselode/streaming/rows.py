"""Row-local stages on a stream of documents: what they do to a row doesn't depend on any other row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..schema import DOCUMENTS

DOC = ["topic", "doc"]


def documents(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A stream of the Parquet files of documents that come into a folder, at most ``files`` a batch."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files).parquet(path)


def phrases(docs: DataFrame) -> DataFrame:
    """topic, doc, sent, start, n_tokens, surface of each document as it comes; no state is kept."""
    return chunking.noun_phrases(chunking.tagged(chunking.sentences(docs)), DOC)


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of rows to Parquet, each input once, until what is there is done."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
