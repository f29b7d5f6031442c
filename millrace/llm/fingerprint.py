"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words (lower-cased; weight: how often). Each word is dealt by hash to one of ``SAMPLES`` slots,
and in a slot the word that wins is sampled by its weight: with gamma variables r, c and a uniform b that depend on the
word alone, t = floor(ln(weight) / r + b), and the word of the smallest a = c / exp(r * (t - b) + r) wins. The slot's
mark is a hash of the winner and its t. Two documents share a slot's mark with the probability of the generalised
Jaccard similarity (sum of smaller weights over sum of larger) of their words in it, so the share of equal slots, each
by its weight, estimates that similarity. Dealing words to slots costs one sample per word rather than one per word and
slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

SAMPLES = 64
#: A word of a larger weight counts as several words of at most this weight, so that it does not sit in one slot alone.
LAYER = 8
#: Hexadecimal digits of a slot's mark and of the weight of its words, in full (a text has fewer than 2^31 bytes); a slot without
#: words is all dashes.
MARK, WEIGHT = 4, 8
SLOT = MARK + WEIGHT
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _uniform(h: Column, k: int) -> Column:
    """A number in (0, 1) that depends on the word's hash and k."""
    return (F.shiftrightunsigned(F.xxhash64(h, F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)


def _sampled(counts: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """One row per document and slot, with for each weight the mark of the slot's winner (null: no word in it).
    counts: keys, word (64-bit hash), weights. Cutting a weight into layers leaves both sums of the similarity as they are."""
    top = F.greatest(*weights) if len(weights) > 1 else F.col(weights[0])
    counts = counts.withColumn("layer", F.explode(F.sequence(F.lit(0), ((top - 1) / LAYER).cast("int"))))
    counts = counts.withColumns({w: F.greatest(F.least(F.col(w) - F.col("layer") * LAYER, F.lit(LAYER)), F.lit(0)) for w in weights})
    counts = counts.withColumn("word", F.when(F.col("layer") > 0, F.xxhash64("word", "layer")).otherwise(F.col("word")))
    h = F.col("word")
    gamma = lambda k: -F.log(_uniform(h, k) * _uniform(h, k + 1))
    df = counts.withColumns({"slot": F.pmod(h, F.lit(SAMPLES)).cast("int"), "r": gamma(1), "c": gamma(3), "b": _uniform(h, 5)})
    df = df.withColumns({f"t_{w}": F.when(F.col(w) > 0, F.floor(F.log(F.col(w)) / F.col("r") + F.col("b"))) for w in weights})
    marks = []
    for w in weights:
        a = F.log("c") - F.col("r") * (F.col(f"t_{w}") - F.col("b")) - F.col("r")
        marks.append(F.min_by(F.when(a.isNotNull(), F.xxhash64(h, f"t_{w}")), a).alias(f"mark_{w}"))
        marks.append(F.sum(w).alias(f"weight_{w}"))
    return df.groupBy(*keys, "slot").agg(*marks)


def _dense(slots: Column, w: str) -> Column:
    """array<struct<mark, weight>> of all slots in order, null where a slot has no word. slots: those of one text, in order, some
    missing; each fills the gap before it, so that the whole takes one pass."""
    kind = "array<struct<mark:int,weight:bigint>>"
    own = F.filter(slots, lambda x: x[f"mark_{w}"].isNotNull())

    def filled(x: Column, i: Column, slots: Column) -> Column:
        gap = x["slot"] - F.coalesce(F.get(slots, i - 1)["slot"] + 1, F.lit(0))
        one = F.array(F.struct(x[f"mark_{w}"].alias("mark"), x[f"weight_{w}"].alias("weight")))
        return F.concat(F.array_repeat(F.lit(None).cast("struct<mark:int,weight:bigint>"), gap).cast(kind), one)

    all_ = F.transform(F.array(own), lambda s: F.concat(F.flatten(F.transform(s, lambda x, i: filled(x, i, s))), F.array_repeat(F.lit(None).cast("struct<mark:int,weight:bigint>"), SAMPLES - 1 - F.coalesce(F.get(s, F.size(s) - 1)["slot"], F.lit(-1)))))
    return F.get(all_, 0).cast(kind)


def printed(slots: Column) -> Column:
    """The fingerprint: the marks and weights of all slots in order, in hexadecimal digits."""
    digits = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    return F.array_join(F.transform(slots, lambda x: F.coalesce(F.concat(digits(x["mark"], MARK), digits(x["weight"], WEIGHT)), F.lit("-" * SLOT))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal marks, each slot counting by the larger of its two weights; 1 if neither fills any. Slots hold
    different weights, and where two texts are alike the larger weight is nearly that of both texts' words together, so
    this share is the similarity without the bias that a plain share has (0.03 too low), at any length (tested at 3,000 and 60,000
    words)."""
    none = F.lit(0).cast("long")
    both = F.zip_with(a, b, lambda x, y: F.struct(F.greatest(F.coalesce(x["weight"], none), F.coalesce(y["weight"], none)).alias("w"), F.coalesce(x["mark"] == y["mark"], F.lit(False)).alias("same")))
    sums = F.aggregate(both, F.struct(none.alias("all"), none.alias("same")), lambda acc, x: F.struct((acc["all"] + x["w"]).alias("all"), (acc["same"] + F.when(x["same"], x["w"]).otherwise(none)).alias("same")), lambda t: F.when(t["all"] > 0, t["same"] / t["all"]).otherwise(1.0))
    return sums


def fingerprints(docs: DataFrame, keys: list[str], texts: list[str], parts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The keys and, for each text t, t_slots (see printed, likeness). The keys must tell rows apart; equal texts get equal
    slots; rows in which no text has a word are left out. docs that are dealt by a key stay where they are. parts: columns of
    docs, each a run of whole words, and the texts that it is part of (else each text is a column of its own)."""
    parts = parts or {t: (t,) for t in texts}
    weights = [f"w{i}" for i in range(len(texts))]
    pieces = [F.struct(F.coalesce(c, F.lit("")).alias("body"), *(F.lit(int(t in of)).cast("long").alias(w) for t, w in zip(texts, weights, strict=True))) for c, of in parts.items()]
    rows = docs.select(*keys, F.explode(F.array(*pieces)).alias("x")).select(*keys, "x.*")
    terms = rows.select(*keys, *weights, F.explode(F.split(F.lower("body"), _SPLIT)).alias("term")).where("term != ''")
    hashed = terms.select(*keys, F.xxhash64("term").alias("word"), *weights)
    counts = hashed.groupBy(*keys, "word").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(texts))))
    slots = _sampled(counts, keys, [f"w{i}" for i in range(len(texts))])
    short = [F.pmod(f"mark_w{i}", F.lit(16**MARK)).cast("int").alias(f"mark_w{i}") for i in range(len(texts))]
    slots = slots.select(*keys, "slot", *short, *(f"weight_w{i}" for i in range(len(texts))))
    found = slots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", *(f"{c}_w{i}" for i in range(len(texts)) for c in ("mark", "weight"))))).alias("slots"))
    return found.select(*keys, *(_dense(F.col("slots"), f"w{i}").alias(f"{t}_slots") for i, t in enumerate(texts)))


def _successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, next_id) for each id of docs (id, n): the next larger id, or the smallest after the largest. Ids are dealt by range,
    so that each range finds its own successors and only the first id of each range is compared across ranges."""
    ids = docs.groupBy("id").agg(F.max("n").alias("n"))
    ranged = scratch.save(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    heads = ranged.groupBy("part").agg(F.min("id").alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    own = ranged.withColumn("follows", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return scratch.save(own.join(heads, "part").select("id", "n", F.coalesce("follows", "after").alias("next_id")), "successors")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs has doc_id and text; other columns are ignored. The edited text is the text with its last floor(n_chars / 4)
    code points replaced by the first as many, or all, of the next document's in the order of doc_id (after the last
    one: the first). A null text counts as empty, and its likeness to another text without words is 1. A null doc_id
    stands before all others. doc_id should be unique: of several rows with one doc_id each gets its own result, and
    the one with the smallest hash of its text is the next document of the id before; equal rows get equal results.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    after = _successors(rows.select("id", F.length("text").alias("n")), scratch)
    dealt = rows.withColumn("th", F.xxhash64("text")).repartition("id")
    single = dealt.groupBy("id", "th").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    heads = single.join(after.select(F.col("id").alias("to"), F.col("n"), F.col("next_id").alias("id")), "id")
    heads = heads.select("to", "th", F.left("text", (F.col("n") / 4).cast("int")).alias("head")).groupBy("to").agg(F.min_by("head", "th").alias("head"))
    cut = (F.length("text") / 4).cast("int")
    edited = single.join(heads.withColumnRenamed("to", "id"), "id").select("id", "th", "copies", "text", F.concat(F.left("text", F.length("text") - cut), F.left("head", cut)).alias("edited"))
    # both texts begin with the same words, up to the last separator of what is left of the text
    both = F.regexp_extract(F.left("text", F.length("text") - cut), f"(?s)^.*{_SPLIT[:-1]}", 0)
    rest = lambda t: F.substring(F.col(t), F.length("both") + 1, F.length(t))
    parted = edited.withColumn("both", both).select("id", "th", "both", rest("text").alias("own"), rest("edited").alias("new"))
    prints = fingerprints(parted, ["id", "th"], ["text", "edited"], {"both": ("text", "edited"), "own": ("text",), "new": ("edited",)})
    none = F.array_repeat(F.lit(None).cast("struct<mark:int,weight:bigint>"), SAMPLES)
    about = edited.select("id", "th", "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    result = about.join(prints, ["id", "th"], "left").withColumns({c: F.coalesce(c, none) for c in ("text_slots", "edited_slots")})
    result = scratch.save(result, "prints")
    follows = result.groupBy("id").agg(F.min_by("text_slots", "th").alias("next_slots")).withColumnRenamed("id", "next_id")
    full = result.join(after.select("id", "next_id"), "id").join(follows, "next_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return full.select(
        F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed(F.col("text_slots")).alias("fingerprint"),
        printed(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("text_slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("text_slots"), F.col("next_slots")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; contract of edited_and_next()."""
    return edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
