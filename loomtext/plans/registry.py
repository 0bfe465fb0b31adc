"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as a Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a DataFrame query; `oracle` is its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query written in SQL that both engines read.

    Tables stand as {documents}; the engines' few differing names are given by `oracle`.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)


def twin(name: str, text: str, oracle: str | None = None) -> None:
    """The DuckDB twin of a query that is registered elsewhere."""
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
