"""Sinks. Files are replaced as a whole by Spark's commit protocol, and rows have one order, so a rerun writes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_json(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """JSON lines in the given order over ``files`` range-partitioned parts."""
    df.select(*sorted(df.columns)).repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def replaced(old: DataFrame, new: DataFrame, own: Column) -> DataFrame:
    """old without the rows that the condition owns, and new: a rerun of one producer leaves the others' rows."""
    return old.where(~F.coalesce(own, F.lit(False))).unionByName(new)


def merged(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Both, each row (or key) once."""
    return old.unionByName(new).dropDuplicates(key)


def archived(rows: DataFrame, archive: DataFrame, void: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, archive with the void ones added, each key once)."""
    gone = F.coalesce(void, F.lit(False))
    return rows.where(~gone), merged(archive, rows.where(gone), [key])


def quarantined(rows: DataFrame, known: DataFrame, column: str, key: str, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose column is a known id, side table with the others added, each key once)."""
    ids = known.select(F.col(key).alias(column)).distinct()
    return rows.join(ids, column, "left_semi"), merged(side, rows.join(ids, column, "left_anti"))
