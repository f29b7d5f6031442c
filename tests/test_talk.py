import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming import talk
from millrace.streaming.talk import Talk


def said(*texts):
    t = Talk()
    return [t.hear(i, x) for i, x in enumerate(texts)]


@pytest.mark.parametrize("turns,kinds", [
    (["How is a rail renewed in src3?", "source", "More", "related"], ["answer", "source", "more", "related"]),
    (["What is the wear limit?", "and on curves"], ["answer", "follow_up"]),
    (["more"], ["no_context"]),
    (["What is the wear limit?", "reset", "more"], ["answer", "reset", "no_context"]),
    (["", None, "ok"], ["answer", "answer", "answer"]),
])
def test_kinds(turns, kinds):
    assert [x[0] for x in said(*turns)] == kinds


def test_topic_and_scope():
    a, b, c, d = said("Limits of wear in src3 please", "what about curves", "How is a joint welded then?", "it is src4 now")
    assert a == ("answer", "Limits of wear in src3 please", "src3")
    assert b == ("follow_up", "Limits of wear in src3 please what about curves", "src3")
    assert c == ("answer", "How is a joint welded then?", "")  # a fresh question is not dragged into the scope before
    assert d == ("follow_up", "How is a joint welded then? it is src4 now", "src4")
    t = Talk()
    assert t.hear(3, "one two three") and t.hear(3, "one two three") is None and t.hear(2, "more") is None


def test_a_stream_with_a_restart_is_the_table(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ["How is it made in src1", "x", "more", "x", "and then", "x", "reset", "x", "source"][t] if c % 3 else f"question number {t} here", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t)) for c in range(12) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at timestamp")
    for part in range(4):
        df.where(f"turn >= {part * 3} AND turn < {part * 3 + 3}").coalesce(1).write.parquet(str(tmp_path / f"parts/{part}"))
    late = spark.createDataFrame([(99, 0, "user", "later by far", datetime.datetime(2024, 1, 3))], df.schema)

    def arrive(frame):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        turns = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = talk.stream(turns).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(talk.OUT).parquet(str(tmp_path / "out"))

    for part in (0, 1):
        arrive(spark.read.schema(df.schema).parquet(str(tmp_path / f"parts/{part}")))
    first = drain()
    assert 0 < first.count() < 12 * 5
    for part in (1, 2, 3):  # the second part comes twice
        arrive(spark.read.schema(df.schema).parquet(str(tmp_path / f"parts/{part}")))
    got = drain()
    want = sorted(map(tuple, talk.replies(df).collect()))
    assert sorted(map(tuple, got.where("kind != 'closed'").collect())) == want
    arrive(late)
    arrive(late.withColumn("conv_id", F.lit(98).cast("long")))
    closed = drain().where("kind = 'closed'").collect()
    assert {r.conv_id for r in closed} == set(range(12)) and {r.turn for r in closed} == {8}
