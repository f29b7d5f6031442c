"""From raw documents to packed training sequences: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, ngram_jaccard, packing, pii, toxicity
from millrace.llm.scratch import Scratch, unused


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold of their language (of none: toxicity.THRESHOLD).

    A null or empty text is scored as no words, a long one whole; repeated rows stay or go together; an empty table gives
    an empty one. All columns are kept as they are, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    scored = toxicity.score(docs, model, tuple(docs.columns), name)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return scored.where(F.col(name) < toxicity.threshold_of(model, lang)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Documents without words (a null, empty or blank text) are no copies and all stay; rows of equal doc_id and text are
    one document, of which one row stays; a null doc_id stands before all others. Texts are compared whole; an empty table
    gives an empty one. All columns are kept as they are, whatever their names.
    """
    return ngram_jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    A null or empty text has no windows and stays; repeated rows stay or go together; texts are read whole; an empty
    table gives an empty one. All columns are kept as they are, whatever their names.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind, and n_chars (where docs has it) set to the new length.

    A null text stays null, an empty one empty; repeated rows give equal rows; texts are searched whole; an empty table
    gives an empty one. All other columns are kept as they are, whatever their names.
    """
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences.

    A null or empty text is one piece of one token; a text over the length of a sequence is cut into pieces; repeated
    rows are packed as often as they occur; an empty table gives no rows. Columns but doc_id and text are ignored.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL has no convolution, trees or packing: tests/llm/test_pipeline.py compares with a version on plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
