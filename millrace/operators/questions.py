"""What a question asks for and which sentences and grids are worth showing: ordered classes and predicates as column expressions.

A null text is of no class and passes no predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a question, and its classes, the first that fits counts.
IS_QUESTION = (r"\?$", r"^(what|which|how|where|can|is|tell|explain|give|show)\b", r"(wear|throw|tolerance|clearance|standard|specification|irs:|is 2062|usfd|inspect|alt 10|alt 11|alt 12|buffer|spare|crack|defect|mitigat)")
INTENTS = {
    "REVISION_COMPARISON": r"(alt 10|alt 11|alt 12|alt 13|revision|alteration|difference|changed in)",
    "INSPECTION_PROCEDURE": r"(inspect|usfd|ultrasonic|scan|check rail clearance|procedure|frequency|protocol)",
    "TOLERANCE_INQUIRY": r"(wear|throw|clearance|tolerance|opening|toe load|torque|limit)",
    "SPECIFICATION_GOVERNANCE": r"(standard|specification|irs:|irs |is:|\bis 2062\b|\bis 814\b|govern|material|grade)",
    "FAILURE_MITIGATION": r"(crack|fracture|defect|failure|mitigat|remedy|risk|squat)",
    "BOM_PROCUREMENT": r"(buffer|spare|bom|procurement|how many|quantity|sets|list-a)",
}
# Commands of a conversation, the first that fits counts; GREETING has four words at most.
POLITE = r"^(?:and |also |please |can you |could you |what about |how about |show me |show |give me |tell me |let me see )+"
GREETING = r"^(hi|hello|hey|namaste|good (morning|afternoon|evening))\b"
COMMANDS = {
    "thanks": r"^(thanks|thank you|ok thanks|great|got it|okay|ok)$",
    "help": r"^(help|what can you do|who are you|what are you|how do you work|what do you know)",
    "reset": r"^(clear|reset|start over|new (question|topic|chat))$",
    "more": r"^(more|more details?|details|full text|(the )?(full )?(text|passage|paragraph)|read (it|the paragraph)|the rest)$",
    "source": r"^((the )?sources?|(the )?page|which page|what page|where (is|was) (this|that|it)( from)?|cite|(the )?citation)$",
    "related": r"^(what else|anything else|related( provisions)?|see also|other (provisions|paragraphs)|more like this)$",
}


def plain(text: Column) -> Column:
    """White space squeezed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _first(text: Column, classes: dict[str, str], other: Column) -> Column:
    out = other
    for name, pattern in reversed(list(classes.items())):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def intent(text: Column) -> Column:
    """The class of a question: UNKNOWN for what is none, COMPONENT_LOOKUP for one of no other class."""
    q = F.lower(F.trim(text))
    asks = F.lit(False)
    for pattern in IS_QUESTION:
        asks |= q.rlike(pattern)
    return F.when(text.isNotNull(), F.when(asks, _first(q, INTENTS, F.lit("COMPONENT_LOOKUP"))).otherwise("UNKNOWN"))


def command(text: Column) -> Column:
    """The command that a turn is, null for none."""
    flat = F.lower(plain(text))
    bare = F.regexp_replace(F.regexp_replace(flat, r"[?.!]+$", ""), POLITE, "")
    return F.when(flat.rlike(GREETING) & (F.size(F.split(flat, " ")) <= 4), "greeting").otherwise(_first(bare, COMMANDS, F.lit(None).cast("string")))


def informative(sentence: Column) -> Column:
    """Whether a sentence can be shown as an answer: at least five words after its marker, no reference back, no amendment mark, no
    short heading."""
    x = plain(sentence)
    words = F.size(F.filter(F.split(F.regexp_replace(x, r"(?i)^\(?[0-9a-z.]{1,8}\)?\s*", ""), " "), lambda w: w.rlike("[A-Za-z]{2,}")))
    return (words >= 5) & ~x.rlike(r"(?i)^\(?back to\b") & ~x.rlike(r"(?i)^\(?acs\b") & ~(x.endswith(":") & (words < 8))


def context(text: Column, start: Column, end: Column, reach: int = 160) -> Column:
    """struct<left, span, right>: a span and up to so many characters on either side."""
    low = F.greatest(start - reach, F.lit(0))
    return F.struct(F.substring(text, low + 1, start - low).alias("left"), F.substring(text, start + 1, end - start).alias("span"), F.substring(text, end + 1, F.lit(reach)).alias("right"))


def quote(sentence: Column, span: Column, longest: int = 300, before: int = 120) -> Column:
    """A sentence, squeezed; a longer one is cut to longest characters from some before the span on, without a broken last word."""
    flat, named = plain(sentence), plain(span)
    begin = F.greatest(F.greatest(F.instr(flat, named) - 1, F.lit(0)) - before, F.lit(0))
    return F.when(F.length(flat) > longest, F.regexp_replace(F.substring(flat, begin + 1, F.lit(longest)), r"\s+\S*$", "")).otherwise(flat)


def grids(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "|") -> DataFrame:
    """(key, rows, cells, full_columns, digit_share, data_table, form) of texts with lines of cells parted by mark. A data table has two
    rows, two columns that are filled in half of the rows (and two), four filled cells and cells under 90 characters on average; a
    form is one of whose cells after the first row under 0.35 have a digit."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("row", "line")).where(F.contains("line", F.lit(mark)))
    cells = lines.select(key, "row", F.posexplode(F.transform(F.split("line", f"[{mark}]"), lambda c: F.trim(c))).alias("column", "cell"))
    first = cells.groupBy(key).agg(F.min("row").alias("head"), F.count_distinct("row").alias("rows"))
    filled = cells.where("cell != ''").join(first, key)
    by_column = filled.groupBy(key, "column", "rows").agg(F.count("*").alias("n"), F.sum(F.length("cell")).alias("chars"), F.count_if(F.col("row") > F.col("head")).alias("body"), F.count_if((F.col("row") > F.col("head")) & F.col("cell").rlike("[0-9]")).alias("digits"))
    told = by_column.groupBy(key, "rows").agg(F.sum("n").alias("cells"), F.count_if(F.col("n") >= F.greatest(F.lit(2.0), F.col("rows") / 2)).alias("full_columns"), F.sum("chars").alias("chars"), F.sum("body").alias("body"), F.sum("digits").alias("digits"))
    table = (F.col("rows") >= 2) & (F.col("full_columns") >= 2) & (F.col("cells") >= 4) & (F.col("chars") < 90 * F.col("cells"))
    share = F.when(F.col("body") > 0, F.round(F.col("digits") / F.col("body"), 6))
    return told.select(key, "rows", "cells", "full_columns", share.alias("digit_share"), table.alias("data_table"), F.coalesce(table & (share < 0.35), F.lit(False)).alias("form"))
