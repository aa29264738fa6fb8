"""Writers of results."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession


def by_topic(df: DataFrame, path: str) -> None:
    """Parquet in a folder a topic; only the topics at hand are overwritten, so a run can be continued."""
    df.repartition("topic").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic").parquet(path)


def table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, csv (with a header) or json lines; arrays and structs of a csv are JSON text."""
    from pyspark.sql import functions as F

    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.select(*(F.to_json(c).alias(c) if c in nested else c for c in df.columns))
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"unknown kind {kind}; there are parquet, csv and json")


def latex(df: DataFrame, most: int = 200) -> str:
    """A small table of results as LaTeX rows; more than ``most`` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a printed table has at most {most} rows")
    cells = lambda r: " & ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r)
    body = [" & ".join(df.columns) + r" \\ \midrule", *(cells(r) + r" \\" for r in rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", *body, r"\bottomrule", r"\end{tabular}"])


class _Plain(pickle.Unpickler):
    """Reads containers of plain values only: a name in a pickle would be code."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is no plain value")


def convert_pickle(spark: SparkSession, source: str, path: str) -> None:
    """A pickled list of (text, labels) or (topic, [(doc, text)], labels) as Parquet documents and gold, once, on the driver."""
    with open(source, "rb") as f:
        items = _Plain(f).load()
    docs, gold = [], []
    for i, item in enumerate(items):
        if len(item) == 2:
            docs.append((None, str(i), item[0], None))
            gold += [(None, str(i), k, 0, p) for k, p in enumerate(item[1])]
        else:
            docs += [(item[0], doc, text, None) for doc, text in item[1]]
            gold += [(item[0], None, k, 0, p) for k, p in enumerate(item[2])]
    from ..schema import DOCUMENTS, GOLD

    unescape = lambda t: t.replace("\\[", "[").replace("\\]", "]")
    spark.createDataFrame([(a, b, unescape(t), d) for a, b, t, d in docs], DOCUMENTS).write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame(gold, GOLD).write.mode("overwrite").parquet(f"{path}/gold")
