"""Answers from ranked candidates, and dialogue state where each turn depends on the one before."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promoted(scored: DataFrame, named: DataFrame, plus: float = 6.0, sure: float = 5.0, question: str = "item_id", key: str = "doc_id") -> DataFrame:
    """scored with candidates that the question names by identifier moved up: by ``plus`` where only the number is named, and
    to ``sure`` above the best other where the source is named too. named: (question, key, exact)."""
    both = scored.join(named, [question, key], "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    other = F.max(F.when(F.col("exact").isNull(), F.col("score"))).over(Window.partitionBy(question))
    up = F.when(F.col("exact"), F.greatest(F.col("score"), F.coalesce(other, F.lit(0.0))) + sure).when(~F.col("exact"), F.col("score") + plus).otherwise(F.col("score"))
    return both.withColumn("score", F.round(up, 6)).drop("exact")


def preferred(candidates: DataFrame, rules: list[Column], order: list[Column], by: list[str]) -> DataFrame:
    """One candidate of each group: the first rule that any fulfils decides (rule: its number from 0), then the order."""
    rule = F.lit(len(rules))
    for k, r in reversed(list(enumerate(rules))):
        rule = F.when(r, k).otherwise(rule)
    w = Window.partitionBy(*by).orderBy("rule", *order)
    return candidates.withColumn("rule", rule).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def located(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """(item_id, doc_id, start, ratio): where a text stands in another, word by word. Its first six words anchor a window of
    the item's length; where they stand nowhere, its first three do, then its first one. The anchor of the best ratio wins;
    under ``least`` only its place counts (ratio null); without an anchor start is -1. pairs: item_id, doc_id, item, body."""

    def place(item: str, body: str) -> tuple[int, float | None]:
        a = re.findall(r"\w+", (item or "").lower())
        spans = [(m.start(), m[0].lower()) for m in re.finditer(r"\w+", body or "")]
        b = [w for _, w in spans]
        for size in (6, 3, 1):
            starts = [i for i in range(len(b) - size + 1) if a and b[i : i + size] == a[:size]]
            if starts:
                best = max(starts, key=lambda i: (difflib.SequenceMatcher(None, a, b[i : i + len(a)], False).ratio(), -i))
                ratio = difflib.SequenceMatcher(None, a, b[best : best + len(a)], False).ratio()
                return spans[best][0], round(ratio, 6) if ratio >= least else None
        return -1, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [place(i, b) for i, b in zip(f["item"], f["body"], strict=True)]
            yield pd.DataFrame({"item_id": f["item_id"], "doc_id": f["doc_id"], "start": [s for s, _ in found], "ratio": pd.Series([r for _, r in found], dtype="float64")})

    return pairs.select("item_id", "doc_id", "item", "body").mapInPandas(run, "item_id long, doc_id long, start int, ratio double")


def dialogue(turns: DataFrame, follow_up: str = r"^(and|what about|it|that|this)\b") -> DataFrame:
    """(conv_id, turn, query, joined): each user turn as a query; one that reads as a follow-up, or has under three words, is
    joined with the focus so far. A conversation is one group, folded in the order of its turns."""
    again = re.compile(follow_up, re.I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        focus, out = "", []
        for r in pdf[pdf["role"] == "user"].sort_values(["turn", "text"]).itertuples():
            text = (r.text or "").strip()
            joined = bool(focus) and (bool(again.search(text)) or len(text.split()) < 3)
            query = f"{focus} {text}" if joined else text
            if not joined:
                focus = text
            out.append((r.conv_id, r.turn, query, joined))
        return pd.DataFrame(out, columns=["conv_id", "turn", "query", "joined"])

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, query string, joined boolean")


def clusters(df: DataFrame, by: str, value: str, reach: float) -> DataFrame:
    """df's (by, value) with the number of the first cluster whose anchor, its first value in ascending order, is within reach."""
    near = lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > reach), F.concat(acc, F.array(v))).otherwise(acc)
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs"))
    g = g.withColumn("anchors", F.aggregate("vs", F.array().cast("array<double>"), near))
    return g.select(by, F.explode("vs").alias(value), "anchors").select(by, value, F.size(F.filter("anchors", lambda a: a <= F.col(value))).alias("cluster"))
