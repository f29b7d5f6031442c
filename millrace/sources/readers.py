"""Sources: every reader takes a schema, keeps what it cannot parse apart, and reads through Spark alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ERROR = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors): one JSON object per line; blank lines are skipped. errors: file, line text."""
    wide = StructType([*schema.fields, StructField(ERROR, StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ERROR}))
    good = parsed.where(F.col(f"r.{ERROR}").isNull() & F.col("r").isNotNull()).select("r.*").drop(ERROR)
    return good, parsed.where(F.col(f"r.{ERROR}").isNotNull() | F.col("r").isNull()).select("file", F.col("value").alias("line"))


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256, duplicate_of): a listing with fingerprints; later paths of equal contents name the first."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    rows = found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first"))
    return rows.join(first, "sha256").select("path", "size", "sha256", F.when(F.col("path") != F.col("first"), F.col("first")).alias("duplicate_of"))


def text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """(file, line) of all text files below a folder; files with a NUL are binary and left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    wanted = lines.where(F.lower("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    binary = wanted.where(F.instr("line", "\0") > 0).select("file").distinct()
    return wanted.join(binary, "file", "left_anti")


def pending(pages: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "sha256", "engine")) -> DataFrame:
    """Pages whose contents were not processed by the same engine before."""
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


def scoped(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) that the condition keeps, and the edges (src, dst, ...) with both ends among them."""
    n = nodes.where(keep)
    ids = n.select("id")
    return n, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
