import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import quality
from millrace.sources import readers, sinks


def test_json_lines_keep_errors_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": bad}\n{"id": 2}\n')
    good, bad = readers.json_lines(spark, str(tmp_path), StructType.fromDDL("id int, x string"))
    assert sorted((r.id, r.x) for r in good.collect()) == [(1, "a"), (2, None)]
    assert [r.line for r in bad.collect()] == ['{"id": bad}']


def test_documents_files_and_text(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"id": 1, "chapters": [{"n": 1}, {"n": 2}]}, indent=1))
    d = readers.json_document(spark, str(tmp_path / "m.json"), StructType.fromDDL("id int, chapters array<struct<n:int>>"))
    assert [r.n for r in d.select(F.inline("chapters")).collect()] == [1, 2]
    sub = tmp_path / "t"
    sub.mkdir()
    (sub / "a.txt").write_text("one\ntwo")
    (sub / "b.txt").write_text("one\ntwo")
    (sub / "c.txt").write_bytes(b"x\0y")
    (sub / "d.bin").write_text("no")
    listed = {r.path.rsplit("/", 1)[1]: r for r in readers.files(spark, str(sub)).collect()}
    assert listed["b.txt"].duplicate_of.endswith("a.txt") and listed["a.txt"].duplicate_of is None and listed["a.txt"].size == 7
    assert sorted((r.file[-5:], r.line) for r in readers.text_files(spark, str(sub)).collect()) == [("a.txt", "one"), ("a.txt", "two"), ("b.txt", "one"), ("b.txt", "two")]


def test_pending_and_scope(spark):
    pages = spark.createDataFrame([(1, 1, "s", "e"), (1, 2, "t", "e")], "doc_id int, page int, sha256 string, engine string")
    assert [r.page for r in readers.pending(pages, pages.where("page = 1")).collect()] == [2]
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, u int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert [(r.src, r.dst) for r in readers.scoped(nodes, edges, F.col("u") == 1)[1].collect()] == [("a", "b")]


def test_sinks_are_repeatable(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, 'a"q')], "k int, v string")
    sinks.ordered_json(df, str(tmp_path / "j"), ["k"])
    one = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*")))
    sinks.ordered_json(df.orderBy("v"), str(tmp_path / "j"), ["k"])
    assert one == "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part*"))) and [json.loads(x)["k"] for x in one.splitlines()] == [1, 2]
    sinks.csv(df.coalesce(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).count() == 2
    sinks.lines(df, "v", str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['a"q', "b"]


def test_partial_replacement(spark):
    old = spark.createDataFrame([("FB:1", 1), ("OCR:1", 2)], "id string, v int")
    new = spark.createDataFrame([("FB:2", 3)], "id string, v int")
    assert sorted(r.id for r in sinks.replaced(old, new, F.col("id").startswith("FB:")).collect()) == ["FB:2", "OCR:1"]
    assert sinks.merged(old, old).count() == 2
    stay, archive = sinks.archived(old, old.where("v = 1"), F.col("v") == 1, "id")
    assert [r.id for r in stay.collect()] == ["OCR:1"] and archive.count() == 1
    ok, side = sinks.quarantined(old, spark.createDataFrame([("FB:1",)], "k string"), "id", "k", old.where("false"))
    assert [r.id for r in ok.collect()] == ["FB:1"] and [r.id for r in side.collect()] == ["OCR:1"]


def test_faults_are_caught(spark):
    clean = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    rule = {"v over 5": F.col("v") > 5}
    assert quality.violations(clean.where("k = 1"), "k", rule).collect() == []
    assert quality.violations(clean, "k", rule).collect() == [("v over 5", 2)]
    assert quality.duplicates(clean, "k").collect() == [] and quality.duplicates(clean.union(clean), "k").count() == 2
    assert quality.dangling(clean, "k", "v", clean.where("v = 5"), "v").collect() == [("dangling", 2)]
    assert quality.set_difference(clean, clean, "k").collect() == []
    assert sorted(quality.set_difference(clean, clean.where("k = 1"), "k").collect()) == [("only in first", 2)]
