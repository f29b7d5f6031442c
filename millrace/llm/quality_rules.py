"""Quality rules: fixed limits, then robust outliers among the documents that keep them.

Each document has a vector of transformed statistics. For each language and source, for each language, and for all, the
minimum covariance determinant gives a centre and a scatter: those of the share CORE of documents that lie closest together,
found by concentration steps from coordinatewise medians. A document is rejected if its squared Mahalanobis distance from
the estimate of its language and source is over CUT. Estimates of few documents lean on those of the language, and these on
those of all, in proportion to their numbers, so one rule holds at every size.

Statistics are whole numbers of 1/GRID, so that sums and ranks are exact and no verdict depends on the order of rows. Equal
vectors are counted before anything is dealt out: copies weigh as many as they are, in one row. All of it is built-in
expressions; what the driver reads is one number a step.

Cases: a null, empty or blank text has no words and fails; a null language or source is a value of its own; repeated rows are
judged alike; a text is read whole, in one row; an empty table gives no rows; other columns are ignored, whatever their
names (of clean(): kept).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base limits: fewest words, and the percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

GRID = 1000
#: Words (lines) that are added to each text's counts, so that short texts vary no more than long ones do.
PRIOR_WORDS, PRIOR_LINES, PRIOR_LENGTH = 50, 5, 5.0
#: Least standard deviation of each statistic: most documents have no symbols, repeated lines or windows at all.
FLOORS = (0.05, 0.06, 0.1, 0.08)
P = len(FLOORS)
#: Share of the documents that an estimate rests on; what is left may be of any kind.
CORE = 0.65
#: Documents as many as which a wider group's estimate counts.
LEAN = 30
#: Chance of a normal vector beyond the cut, and most concentration steps (each lowers the determinant, few are needed).
TAIL, STEPS = 1e-6, 15


def _chi2(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))


def _chi2_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if _chi2((low + high) / 2, degrees) < q else (low, (low + high) / 2)
    return low


CUT = _chi2_quantile(1 - TAIL, P)
#: By which the scatter of the core of a normal sample falls short.
CONSISTENCY = CORE / _chi2(_chi2_quantile(CORE, P), P + 2)


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, with COUNTS, n_lines (with a word) and base_failed of each text. Columns of keep must not have these names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.length(F.translate(text, SPACE, ""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(SPACE)) != "")
    d = docs.select(*keep, some.cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.transform(words, lambda w: F.xxhash64(w)).alias("_h"), lines.alias("_l"))
    d = d.select("*", F.size("_h").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines")).drop("_l")
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(WINDOW))))).drop("_h")
    # places of windows, in the order of their hashes: equal ones are neighbours
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).drop("_w")
    at = lambda i: F.get("_s", i)["w"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get("_s", i)["i"])))).drop("_s")
    covered = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")))
    d = d.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0).cast("long"))).drop("_p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.select(*keep, *COUNTS, "n_lines", failed.alias("base_failed"))


def vectors(counted: DataFrame) -> DataFrame:
    """counted with x0 to x3, in units of 1/GRID: the log of the mean word length, and the square roots of the shares of symbols
    (by words), of repeated lines and of words in repeated windows."""
    n, lines = F.col("n_words") + PRIOR_WORDS, F.col("n_lines") + PRIOR_LINES
    x = [F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]
    return counted.select("*", *(F.round(v * GRID).cast("long").alias(f"x{i}") for i, v in enumerate(x)))


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def group_key(level: int, lang: Column | None, source: Column | None) -> Column:
    """Tells a language and source (level 0), a language (1) and all (2) apart, nulls included."""
    return F.to_json(F.array(F.lit(str(level)), *(c.cast("string") for c in (lang, source) if c is not None)))


def cells(found: DataFrame) -> DataFrame:
    """(key, x0.., n): the vectors of documents that keep the base rules, counted for each of their three groups."""
    lang, source = F.col("lang"), F.col("source")
    keys = F.explode(F.array(group_key(0, lang, source), group_key(1, lang, None), group_key(2, None, None)))
    counted = found.where("NOT base_failed").groupBy("lang", "source", *X).agg(F.count("*").alias("n"))
    return counted.select(keys.alias("key"), *X, "n").groupBy("key", *X).agg(F.sum("n").alias("n"))


def precision(df: DataFrame) -> DataFrame:
    """df (m0.., c00.., in units of 1) with p00..: the inverse of the covariances plus FLOORS, by Cholesky's factors."""
    c = lambda i, j: F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
    for i, j in sorted(PAIRS):
        rest = c(i, j) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i, j in sorted(PAIRS, key=lambda p: (p[0] - p[1], p[0])):
        of = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))
        df = df.withColumn(f"v{i}{j}", of / F.col(f"l{i}{i}"))
    products = {(i, j): sum((F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(i, P)), F.lit(0.0)) for i, j in PAIRS}
    return df.select("*", *(v.alias(f"p{i}{j}") for (i, j), v in products.items())).drop(*(f"{a}{i}{j}" for a in "lv" for i, j in PAIRS))


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by p00..."""
    apart = [F.col(x) / GRID - F.col(f"m{i}") for i, x in enumerate(X)]
    return sum((F.col(f"p{i}{j}") * apart[i] * apart[j] * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))


SHAPE = ["key", "size", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]


def _started(counted: DataFrame) -> DataFrame:
    """SHAPE from medians and median deviations; sizes are numbers of documents."""
    middle = lambda c: F.percentile(c, 0.5, F.col("n"))
    centres = counted.groupBy("key").agg(F.sum("n").alias("size"), *(middle(F.col(x)).alias(f"m{i}") for i, x in enumerate(X)))
    near = counted.join(centres, "key")
    spread = near.groupBy("key").agg(*(middle(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"s{i}") for i, x in enumerate(X)))
    scatter = [(F.pow(1.4826 / GRID * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return centres.join(spread, "key").select("key", "size", *((F.col(f"m{i}") / GRID).alias(f"m{i}") for i in range(P)), *scatter)


def _concentrated(counted: DataFrame, now: DataFrame) -> DataFrame:
    """One step: SHAPE of the CORE share of documents that are closest by the estimate now. Distances are compared by whole
    hundredths of their logarithm, so that a rank needs no more than some thousand counts in a group."""
    rank = F.round(100 * F.log1p(distance())).cast("long")
    by = precision(now)
    limits = counted.join(by, "key").groupBy("key").agg(F.percentile(rank, CORE, F.col("n")).alias("limit"))
    inner = counted.join(by.join(limits, "key"), "key").where(rank <= F.col("limit"))
    exact = lambda c: F.sum(F.col("n").cast("decimal(19,0)") * c.cast("decimal(18,0)"))
    sums = inner.groupBy("key").agg(F.first("size").alias("size"), F.sum("n").alias("k"), *(exact(F.col(x)).alias(f"a{i}") for i, x in enumerate(X)), *(exact(F.col(X[i]) * F.col(X[j])).alias(f"b{i}{j}") for i, j in PAIRS))
    mean = lambda i: F.col(f"a{i}").cast("double") / F.col("k") / GRID
    means = sums.select("*", *(mean(i).alias(f"m{i}") for i in range(P)))
    scatter = [(CONSISTENCY * (F.col(f"b{i}{j}").cast("double") / F.col("k") / GRID**2 - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}{j}") for i, j in PAIRS]
    return means.select("key", "size", *(f"m{i}" for i in range(P)), *scatter)


def estimates(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """SHAPE of every group of cells, once steps change none of them (or after STEPS)."""
    now, told = scratch.save(_started(counted), "estimate"), None
    for step in range(STEPS):
        now = scratch.save(_concentrated(counted, now), f"estimate{step}")
        state = now.agg(F.sum(F.xxhash64(*SHAPE).cast("decimal(38,0)"))).first()[0]
        if state == told:
            break
        told = state
    return now


def leaning(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """groups (lang, source) with m0.. and c00..: their own estimate, their language's and that of all, mixed: a wider one counts
    as much as LEAN documents. A mixture's scatter holds the distance between its parts, too."""
    lang, source = F.col("lang"), F.col("source")
    df = groups.select("lang", "source", group_key(0, lang, source).alias("key0"), group_key(1, lang, None).alias("key1"))
    whole = shapes.where(F.col("key") == group_key(2, None, None)).first()  # one row
    df = df.select("*", *(F.lit(whole and whole[c]).alias(f"{c}_2") for c in SHAPE))
    for level in range(2):
        named = {f"{c}_{level}": F.col(c) for c in SHAPE}
        of = shapes.select(*(v.alias(k) for k, v in named.items()))
        df = df.join(of, F.col(f"key{level}") == F.col(f"key_{level}"), "left")
    own, wide = (F.coalesce(F.col(f"size_{k}") / (F.col(f"size_{k}") + LEAN), F.lit(0.0)) for k in (0, 1))
    weights = [own, (1 - own) * wide, (1 - own) * (1 - wide)]
    df = df.select("*", *(w.alias(f"w_{k}") for k, w in enumerate(weights)))
    mixed = lambda of: sum((F.when(F.col(f"w_{k}") > 0, F.col(f"w_{k}") * of(k)).otherwise(0.0) for k in range(3)), F.lit(0.0))
    df = df.select("*", *(mixed(lambda k, i=i: F.col(f"m{i}_{k}")).alias(f"m{i}") for i in range(P)))
    apart = lambda i, k: F.col(f"m{i}_{k}") - F.col(f"m{i}")
    return df.select("lang", "source", *(f"m{i}" for i in range(P)), *(mixed(lambda k, i=i, j=j: F.col(f"c{i}{j}_{k}") + apart(i, k) * apart(j, k)).alias(f"c{i}{j}") for i, j in PAIRS))


def fitted(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(of_lang, of_source, m0.., p00..) of each language and source of vectors: centre and inverse scatter."""
    shapes = estimates(scratch.save(cells(found), "cells"), scratch)
    groups = found.where("NOT base_failed").select("lang", "source").distinct()
    return scratch.save(precision(leaning(groups, shapes)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "groups")


def verdicts(found: DataFrame, by: DataFrame) -> DataFrame:
    """found (vectors) with distance (squared; null where the base rules fail) and kept."""
    both = found.join(by, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    far = F.when(~F.col("base_failed"), distance())
    return both.select(*found.columns, far.alias("distance"), F.coalesce(far <= CUT, F.lit(False)).alias("kept"))


def judged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, COUNTS, base_failed, distance, kept) of every document. Texts are read once."""
    found = scratch.save(vectors(counts(docs, ("doc_id", "lang", "source"))), "vectors")
    by = fitted(found, scratch)
    scratch.drop_others("vectors", "groups")
    return verdicts(found, by).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def clean(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are read twice and never written."""
    names = [f"keep_{i}" for i in range(len(docs.columns))]
    inner = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), "lang", "source", "text")
    found = scratch.save(vectors(counts(inner, ("lang", "source"))), "vectors")
    by = fitted(found, scratch)
    scratch.drop_others("groups")
    told = verdicts(vectors(counts(inner, (*names, "lang", "source"))), by)
    return told.where("kept").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict on every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op12"))
