"""Ratchets: counts of faults that may only fall. A baseline is a kept table of the lowest counts so far, replaced as a whole.

Each baseline is a folder of its own under the ratchet's path, named by its number; a new one is written beside the others under
another name and gets its number by one rename, so that a reader sees the old table or the new one, never a part. Of two
writers of one number the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "rule string, n long"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _latest(spark: SparkSession, path: str) -> int:
    hadoop, files = _files(spark, path)
    if not files.exists(hadoop(path)):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(hadoop(path))]
    return max((int(n) for n in names if n.isdigit()), default=0)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule, n) of the last baseline; no rows where there is none."""
    number = _latest(spark, path)
    return spark.read.schema(COUNTS).parquet(f"{path}/{number}") if number else spark.createDataFrame([], COUNTS)


def compared(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rule, before, now, status) of both tables of counts (rule, n): ``worse`` and ``better``, ``same``, and ``new`` for a rule that had no
    baseline. A rule without a count now has none broken."""
    both = before.select("rule", F.col("n").alias("before")).join(now.select("rule", F.col("n").alias("now")), "rule", "full").withColumn("now", F.coalesce("now", F.lit(0).cast("long")))
    status = F.when(F.col("before").isNull(), "new").when(F.col("now") > F.col("before"), "worse").when(F.col("now") < F.col("before"), "better").otherwise("same")
    return both.select("rule", "before", "now", status.alias("status"))


def advance(report: DataFrame, path: str) -> int:
    """The next baseline, written from a report: of every rule the lower count. Gives its number."""
    spark = report.sparkSession
    hadoop, files = _files(spark, path)
    number, new = _latest(spark, path) + 1, f"{path}/_{uuid.uuid4().hex}"
    report.select("rule", F.least(F.coalesce("before", "now"), "now").alias("n")).write.parquet(new)
    if files.exists(hadoop(f"{path}/{number}")) or not files.rename(hadoop(new), hadoop(f"{path}/{number}")):
        raise OSError(f"baseline {number} of {path} was written meanwhile")
    return number


def reextracted(kept: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(rule, keys): kept rows that a fresh extraction does not give (``stale``), fresh ones that are not kept (``missing``), and those
    of one key whose values differ (``differs``). keys tell rows apart and are never null."""
    a, b = kept.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_kept")), fresh.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_fresh"))
    both = a.join(b, keys, "full")
    rule = F.when(F.col("_kept").isNull(), "missing").when(F.col("_fresh").isNull(), "stale").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", *keys)
