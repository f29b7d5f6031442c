import pytest
from pyspark.sql import functions as F

from millrace.operators import questions as Q


def of(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_intents_in_order(spark):
    texts = ["What changed in alt 11 for wear?", "Usfd procedure", "What is the wear limit?", "Which material grade", "crack remedy", "how many sets", "Where is it?", "a plain statement", "", None]
    assert of(spark, Q.intent, *texts) == ["REVISION_COMPARISON", "INSPECTION_PROCEDURE", "TOLERANCE_INQUIRY", "SPECIFICATION_GOVERNANCE", "FAILURE_MITIGATION", "BOM_PROCUREMENT", "COMPONENT_LOOKUP", "UNKNOWN", "UNKNOWN", None]


def test_commands(spark):
    texts = ["Hello", "hello there my old good friend", "Thanks!", "please show me the source?", "and more details", "what else", "start over", "What can you do now", "wear of rails", None]
    assert of(spark, Q.command, *texts) == ["greeting", None, "thanks", "source", "more", "related", "reset", "help", None, None]


@pytest.mark.parametrize("text,want", [("(a) Rails are laid on five sleepers here.", True), ("11.4.1 Equipment:", False), ("(Back to the first part of this long list)", False), ("ACS number three of the year twenty four", False), ("These are the parts that follow:", False), ("One two three four", False), ("", False), (None, None)])
def test_informative(spark, text, want):
    assert of(spark, Q.informative, text) == [want]


def test_context_and_quote(spark):
    text = "a" * 200 + " 42 " + "b" * 200
    row = spark.createDataFrame([(text,)], "t string").select(Q.context(F.col("t"), F.lit(201), F.lit(203)).alias("x"), Q.quote(F.lit("w " * 200 + "42 " + "v " * 200), F.lit("42")).alias("q"), Q.quote(F.lit("short  42"), F.lit("42")).alias("s")).first()
    assert (row.x.left, row.x.span, row.x.right) == ("a" * 159 + " ", "42", " " + "b" * 159)
    assert "42" in row.q and len(row.q) <= 300 and row.q.startswith("w ") and row.s == "short 42"


def test_grids(spark):
    rows = [(1, "part | size\nrail | 60\njoint | 52"), (2, "one | wide\n | \n | "), (3, "name | place\na | b\nc | d"), (4, "no cells"), (5, None), (6, "x | " + "y" * 400 + "\nz | " + "w" * 400)]
    got = {r.doc_id: (r.rows, r.cells, r.full_columns, r.digit_share, r.data_table, r.form) for r in Q.grids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 6, 2, 0.5, True, False), 2: (3, 2, 0, None, False, False), 3: (3, 6, 2, 0.0, True, True), 6: (2, 4, 2, 0.0, False, False)}
