"""Name -> query and name -> SQL of every registered operator outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("answering", "evaluation", "exchange", "graphs", "language", "quality", "ranking", "relational", "retrieval", "sequences", "texts")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Inventory rows that each query covers.
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Imports every module that registers queries."""
    for name in PLANS:
        import_module(f"millrace.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["bm25_topk"](spark, sf_dir)
