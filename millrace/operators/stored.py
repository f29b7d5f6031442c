"""Tables between two jobs of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: bytes of rows in a batch for Python, which stands several times in an executor, outside the heap;
#: shuffle files are removed when the write ends.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: later jobs do not compute it anew, and a lost executor costs only rereading it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """Writes df as Parquet. Meanwhile batches sent to Python are small, and afterwards the shuffle files of the write go."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        df.write.options(**options or {}).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
