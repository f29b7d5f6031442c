"""Constraints as queries that give violations (rule, key); no row means the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks, in one pass. rules: name -> condition that is true where it is broken."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return df.select(F.explode(broken).alias("rule"), F.col(key).alias("key"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate key").alias("rule"), F.col(key).alias("key"))


def repeated(df: DataFrame, by: list[str], key: str, rule: str) -> DataFrame:
    """The smallest key of each group of several rows that agree in ``by``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("key")).where("n > 1").select(F.lit(rule).alias("rule"), "key")


def dangling(df: DataFrame, key: str, reference: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference is in no row of target; a null reference dangles too."""
    missing = df.join(target.select(F.col(target_key).alias(reference)), reference, "left_anti")
    return missing.select(F.lit("dangling").alias("rule"), F.col(key).alias("key"))


def backward(df: DataFrame, by: list[str], order: str, value: str, rule: str) -> DataFrame:
    """Rows after which the value falls."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__after", after).where(F.col("__after") < F.col(value)).select(F.lit(rule).alias("rule"), F.col(order).alias("key"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only; none if the stores agree."""
    one = a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit("only in first").alias("rule"), F.col(key).alias("key"))
    return one.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit("only in second").alias("rule"), F.col(key).alias("key")))
