"""Term counts, corpus statistics and scores of every pair, for a batch of questions (see blocks for the best of each)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import bm25, idf
from millrace.functions.text import terms
from millrace.operators.stored import stored


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None, title_weight: int = 3) -> DataFrame:
    """(key, term, tf, length): term counts of each document, title terms counted ``title_weight`` times in tf and once in length."""
    body = docs.select(key, F.explode(terms(F.col(text))).alias("term"), F.lit(1).alias("weight"))
    if title:
        body = body.unionByName(docs.select(key, F.explode(terms(F.col(title))).alias("term"), F.lit(title_weight).alias("weight")))
    counts = body.groupBy(key, "term").agg(F.sum("weight").cast("double").alias("tf"), F.count("*").alias("n"))
    return counts.select(key, "term", "tf", F.sum("n").over(Window.partitionBy(key)).cast("double").alias("length"))


def statistics(index: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int, float]:
    """(df of each term, number of indexed documents, their average length)."""
    lengths = index.groupBy(key).agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    return index.groupBy("term").agg(F.count("*").cast("double").alias("df")), lengths["n"], lengths["average"] or 1.0


@dataclass(frozen=True)
class Index:
    """(key, term, tf, length) of the terms that questions ask for, the number of documents and their average length."""

    rows: DataFrame
    key: str
    documents: int
    average: float

    def frequencies(self) -> DataFrame:
        """(term, df)."""
        return self.rows.groupBy("term").agg(F.count("*").cast("double").alias("df"))


def index_for(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The part of an index that a batch of questions needs, written once: documents are read and split a single time, and only
    occurrences of asked terms are counted and shuffled. key tells documents apart. The empty term, which every document
    has, carries the lengths."""
    asked = questions.select(F.explode(F.concat(F.array(F.lit("")), terms(F.col(text)))).alias("term")).distinct()
    words = docs.select(key, terms(F.col(text)).alias("words")).where("size(words) > 0")
    held = words.select(key, F.size("words").cast("double").alias("length"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    rows = held.join(asked, "term").groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"), F.max("length").alias("length"))
    rows = stored(rows, "index")
    about = rows.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    return Index(rows.where("term != ''"), key, about["n"], about["average"] or 1.0)


def score(questions: DataFrame, index: Index, within: DataFrame | None = None, question: str = "item_id", text: str = "text") -> DataFrame:
    """(question, key, score, hits): BM25 over the distinct terms of each question, one row per candidate. within: the keys that
    may be candidates (None: all); frequencies and lengths are those of all documents."""
    weighted = _weighted(questions, index, question, text)
    part = F.col("idf") * bm25(F.col("tf"), F.col("length"), F.lit(float(index.average)))
    rows = index.rows if within is None else index.rows.join(within.select(index.key), index.key, "left_semi")
    return weighted.join(rows, "term").groupBy(question, index.key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hits"))


def _weighted(questions: DataFrame, index: Index, question: str, text: str) -> DataFrame:
    """(question, term, idf) of the distinct terms of each question that any document has."""
    wanted = questions.select(question, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    return wanted.join(index.frequencies(), "term").withColumn("idf", idf(F.lit(float(index.documents)), F.col("df"))).select(question, "term", "idf")


def top(scored: DataFrame, k: int, question: str = "item_id", key: str = "doc_id") -> DataFrame:
    """The k best of each question, ties by key, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
