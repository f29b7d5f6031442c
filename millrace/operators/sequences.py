"""Order-dependent operators: windows where they can say it, folds over one document or group where they cannot."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stored import stored


def islands(df: DataFrame, by: list[str], order: list[str], new: Column) -> DataFrame:
    """df with island: how many rows up to this one, in order, begin a new run (new is true)."""
    return df.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def consecutive(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive distinct numbers: by, first, last, size."""
    x = df.select(*by, number).distinct()
    x = x.withColumn("__run", F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number)))
    return x.groupBy(*by, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("__run")


def fill_forward(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def first_of_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def monotone(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds every earlier one of the group: what a filter against the last kept value keeps."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__top", F.max(value).over(w)).where(F.col("__top").isNull() | (F.col(value) > F.col("__top"))).drop("__top")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 1, in an order of all rows: rows are dealt by ranges, each range is numbered by itself
    and starts after all rows of the ranges before it."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    own = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    out = own.join(sizes.select("__range", before.alias("__before")), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__k")).drop("__range", "__k", "__before")


def longest_increasing(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, order, value) of one longest strictly increasing subsequence of each group (the one that patience sorting with
    back-pointers finds); rows of equal order stand by value. A group is one document's lines, so it fits a task; groups are
    sorted beside each other and folded in one pass, however many there are."""
    rows = df.select(by, order, value).dropna()
    return rows.repartition(by).sortWithinPartitions(by, order, value).mapInArrow(_increasing, rows.schema)


def _increasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept rows of sorted groups; a group that the end of a batch cuts goes on with the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = bool(held) and held[-1].column(0)[-1] != batch.column(0)[0]
        begins = np.flatnonzero(_changes(batch.column(0))) + 1
        cut = int(begins[-1]) if len(begins) else 0
        if cut or first:
            yield from _longest([*held, batch.slice(0, cut)]).to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _longest(held).to_batches()


def _changes(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """For each key but the first, whether it is another than the one before."""
    return pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)


def _longest(batches: list[pa.RecordBatch]) -> pa.Table:
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return rows
    ends = [*(np.flatnonzero(_changes(rows.column(0).chunk(0))) + 1).tolist(), rows.num_rows]
    values = pc.rank(rows.column(2), tiebreaker="dense").to_pylist()
    keep, back, start = [], [-1] * rows.num_rows, 0
    for end in ends:
        tails: list[int] = []
        at: list[int] = []
        for i in range(start, end):
            k = bisect.bisect_left(tails, values[i])
            if k:
                back[i] = at[k - 1]
            if k == len(tails):
                tails.append(values[i])
                at.append(i)
            else:
                tails[k], at[k] = values[i], i
        i = at[-1]
        while i >= 0:
            keep.append(i)
            i = back[i]
        start = end
    return rows.take(pa.array(sorted(keep)))


def passages(docs: DataFrame, soft: int = 700, hard: int = 1100, tail: int = 200) -> DataFrame:
    """(doc_id, k, text): lines that are not blank, packed greedily. A passage closes before the next line once it has ``soft``
    characters, or would have over ``hard``; one of over twice ``hard`` (a single long line) is cut at ``hard``; a last one
    under ``tail`` joins the one before. A text without such lines is one passage, itself; a null text an empty one."""

    def pack(text: str) -> list[str]:
        done: list[str] = []
        now: list[str] = []
        size = 0  # characters of now, joined
        for line in (text or "").split("\n"):
            if not line.strip():
                continue
            if now and (size >= soft or size + len(line) > hard):
                done.append("\n".join(now))
                now, size = [], 0
            now.append(line)
            size += len(line) + (len(now) > 1)
            if size > 2 * hard:
                whole = "\n".join(now)
                cuts = -(-(size - 2 * hard) // hard)
                done += [whole[k * hard : (k + 1) * hard] for k in range(cuts)]
                now, size = [whole[cuts * hard :]], size - cuts * hard
        if now:
            last = "\n".join(now)
            if done and size < tail:
                done[-1] += "\n" + last
            else:
                done.append(last)
        return done or [text or ""]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(text=[pack(t) for t in f["text"]]).explode("text").dropna(subset=["text"])
            f["k"] = f.groupby(level=0).cumcount()
            yield f[["doc_id", "k", "text"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, k int, text string")
