"""Queries of sources, sinks and streams: tables go out in a format and come back through its reader."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.stored import shared_folder
from millrace.registry import query, table
from millrace.sources import readers, sinks
from millrace.streaming import feedback


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1 S2", """SELECT c_custkey, c_name, NULL::VARCHAR AS line FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT NULL, NULL, '{"c_custkey": ' || c_custkey || ', "c_name":' FROM customer WHERE c_custkey % 50 = 0""")
def json_lines_read(spark, d):
    """Customers as JSON lines, of which some are cut short: records, and the lines that are none."""
    c, at = table(spark, d, "customer"), _place(spark, "lines")
    whole, cut = F.to_json(F.struct("c_custkey", "c_name")), F.format_string('{"c_custkey": %d, "c_name":', "c_custkey")
    sinks.lines(c.select(F.when(F.col("c_custkey") % 50 != 0, whole).otherwise(cut).alias("line")), "line", at)
    good, bad = readers.json_lines(spark, at, StructType.fromDDL("c_custkey long, c_name string"))
    return good.withColumn("line", F.lit(None).cast("string")).unionByName(bad.select("line"), allowMissingColumns=True)


@query("S3", "SELECT r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def json_document_read(spark, d):
    """Regions and their nations as one indented JSON document."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))  # a fixed table
    r = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nations")
    at = _place(spark, "document")
    sinks.lines(r.agg(F.to_json(F.collect_list(F.struct("r_name", "nations")), {"pretty": "true"}).alias("text")).coalesce(1), "text", at)
    read = readers.json_document(spark, at, StructType.fromDDL("r_name string, nations array<struct<n_nationkey:int,n_name:string>>"))
    return read.select("r_name", F.inline("nations"))


@query("S8 S10", "SELECT 'line' AS kind, n_name AS name, 2 AS n FROM nation UNION ALL SELECT 'file', 'listed', 50 UNION ALL SELECT 'file', 'duplicate', 25")
def text_files_read(spark, d):
    """Nations written twice, a file each: the lines that come back, and the files that repeat others."""
    n, at = table(spark, d, "nation"), _place(spark, "files")
    for copy in "ab":
        n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition("k").write.partitionBy("k").text(f"{at}/{copy}")
    rows = readers.text_files(spark, at).groupBy(F.col("line").alias("name")).agg(F.count("*").cast("int").alias("n")).select(F.lit("line").alias("kind"), "name", "n")
    listed = readers.files(spark, at, "*.txt")
    count = lambda name, df: df.agg(F.lit("file").alias("kind"), F.lit(name).alias("name"), F.count("*").cast("int").alias("n"))
    return rows.unionByName(count("listed", listed)).unionByName(count("duplicate", listed.where("duplicate_of IS NOT NULL")))


@query("K1 K9", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def ordered_json_written(spark, d):
    """Orders as JSON lines in one order, written twice to one place: the second write replaces the first."""
    o, at = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _place(spark, "orders")
    sinks.ordered_json(o.where("o_orderstatus = 'F'"), at, ["o_orderkey"])
    sinks.ordered_json(o, at, ["o_orderkey"], 4)
    return readers.json_lines(spark, at, o.schema)[0]


@query("K7", "SELECT p_brand, p_type, count(*) AS items, 'x\"' || p_brand || ', ' || p_type AS note FROM part GROUP BY ALL")
def csv_written(spark, d):
    """A list of parts as CSV with quotes and commas in it, and back."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("items"))
    p, at = p.withColumn("note", F.concat(F.lit('x"'), "p_brand", F.lit(", "), "p_type")), _place(spark, "csv")
    sinks.csv(p, at)
    return spark.read.schema(p.schema).option("header", True).csv(at)


@query("K3", "SELECT c_custkey AS id, 'kept' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier")
def partial_replacement(spark, d):
    """A producer's own rows (every third) give way to its new ones; the others' stay."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("kept").alias("origin"))
    return sinks.replaced(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("new").alias("origin")), F.col("id") % 3 == 0)


@query("K5 F18", "SELECT 'stays' AS place, doc_id AS key FROM labels WHERE quality <> 0 AND doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'archive', doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)")
def archived_rows(spark, d):
    """Void labels move to the archive, each once however often it moves; labels of documents that exist stay."""
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    stay, archive = sinks.archived(labels, labels.where("quality = 0 AND doc_id % 2 = 0"), F.col("quality") == 0, "doc_id")
    place = lambda df, name: df.select(F.lit(name).alias("place"), F.col("doc_id").alias("key"))
    return place(stay, "stays").unionByName(place(archive, "archive"))


@query("K10", "SELECT 'known' AS place, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) UNION ALL SELECT 'quarantine', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def quarantined_rows(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    ok, side = sinks.quarantined(line, table(spark, d, "part").where("p_size < 40"), "l_partkey", "p_partkey", line.where("false"))
    side = side.dropDuplicates(["l_partkey"])
    return ok.agg(F.lit("known").alias("place"), F.count("*").alias("n")).unionByName(side.agg(F.lit("quarantine").alias("place"), F.count("*").alias("n")))


@query("streaming", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark, d):
    """Events as a stream of files, counted by day and type."""
    e, at = table(spark, d, "events"), _place(spark, "events")
    e.repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    counted = feedback.counts(feedback.source(spark, f"{at}/in", e.schema, 2))
    return feedback.written(counted, f"{at}/out", f"{at}/checkpoint").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
