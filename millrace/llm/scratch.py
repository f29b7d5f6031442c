"""Tables between two jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting for bytes of rows that are sent to Python at once, and a value of it: a batch stands several times in an
#: executor (Arrow vectors, the bytes sent, the worker's copy), all outside the heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until it is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder for one call's intermediate tables: written once, so a lost executor costs only rereading them."""

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int | None = None):
        """batch_bytes: of the batches that a write sends to Python (else as the session has it)."""
        self.spark, self.names = spark, []
        self.settings = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again; the shuffle files of the write go with it."""
        path = f"{self.path}/{name}"
        self.names.append(name)
        before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_others(self, *kept: str) -> None:
        """Drops the tables that are not needed once the kept ones are written."""
        for name in [n for n in self.names if n not in kept]:
            self.names.remove(name)
            self.drop(name)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
