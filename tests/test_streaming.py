import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.streaming import feedback as S


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").limit(300)
    e = e.unionByName(e.where("event_id % 5 = 0")).persist()
    day = F.dense_rank().over(Window.orderBy("ts"))  # files follow each other in time
    ranked = e.withColumn("part", F.floor(day / 80)).persist()
    for k in range(5):
        ranked.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return folder, e


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_windows_match_the_batch(spark, parts):
    folder, e = parts
    stream = S.source(spark, str(folder / "in"), e.schema, 10)
    same(S.drain(S.counts(stream), "tumbling", "complete", str(folder / "c1")).select("start", "event_type", "n"), S.counts(e).select("start", "event_type", "n"))
    same(S.drain(S.counts(stream, "1 day", "6 hours"), "sliding", "complete", str(folder / "c2")).select("start", "event_type", "n"), S.counts(e, "1 day", "6 hours").select("start", "event_type", "n"))
    same(S.drain(S.sessions(stream), "runs", "complete", str(folder / "c3")), S.sessions(e))


def test_copies_pass_once(spark, parts):
    folder, e = parts
    stream = S.source(spark, str(folder / "in"), e.schema, 10)
    got = S.drain(S.distinct(stream, "30 days"), "once", "append", str(folder / "c4"))
    assert got.count() == got.select("event_id").distinct().count() == e.select("event_id").distinct().count()


def test_boxes_carry_over_batches(spark, parts):
    folder, e = parts
    stream = S.source(spark, str(folder / "in"), e.schema, 1)
    got = S.drain(S.boxes(stream), "boxes", "update", str(folder / "c5"))
    last = {r.user_id: (r.seen, r.box) for r in got.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max_by("box", "seen").alias("box")).collect()}
    want = {}
    for r in e.orderBy("ts", "event_id").collect():
        seen, box = want.get(r.user_id, (0, 0))
        want[r.user_id] = (seen + 1, min(5, box + 1) if r.event_type == "purchase" else 0 if r.event_type == "error" else box)
    assert last == want
