"""One configuration for the command line and for callers."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    format: str = "parquet"
    paths: tuple[str, ...] = ()
    out: str = "results"
    language: str = "en"
    doc_limit: int = -1
    doc: str | None = None
    min_len: int = 3
    max_words: int = 5
    top_n: int = 15
    extractor: str = "base"  # these names are keys of the tables in plans.pipeline
    embedding: str = "mentions"
    doc_rank: str = "embed"
    mask: str = "all"
    rank: str = "mean"
    diversity: float = 0.5
    stem: bool = True
    places: str | None = None  # Parquet of topic, doc, lat, lon
    index: str = "moran"
    decay: str = "inv"
    decay_parameter: float = 500.0
    distance: str = "vincenty"
    alpha: float = 0.5
    output: str = "parquet"
