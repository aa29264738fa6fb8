"""Command line: python -m phraselode.cli --format topic_json --paths topics.json --out results."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from .config import Config


def parse(argv: list[str] | None = None) -> Config:
    """The options are the configuration's fields."""
    parser = argparse.ArgumentParser(description=__doc__)
    for f in fields(Config):
        default = f.default if f.default is not MISSING else None
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
        elif isinstance(default, tuple):
            parser.add_argument(flag, nargs="+", default=[])
        else:
            parser.add_argument(flag, type=type(default) if default is not None else str, default=default)
    given = vars(parser.parse_args(argv))
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans import pipeline
    from .sources import sinks

    config = parse(argv)
    spark = SparkSession.builder.appName("phraselode").getOrCreate()
    for name, df in pipeline.run(spark, config).items():
        sinks.table(df, f"{config.out}/{name}", config.output)
    spark.stop()


if __name__ == "__main__":
    main()
