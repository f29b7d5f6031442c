"""Queries of ranked retrieval: benchmark items are the questions, documents the passages."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import STOP_WORDS, squash, terms
from millrace.operators import blocks, search
from millrace.operators.stored import stored
from millrace.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN (" + _STOP + "))"
INDEX_SQL = f"""
idx AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS length FROM idx GROUP BY doc_id),
stat AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM len),
df AS (SELECT term, count(*)::DOUBLE AS df FROM idx GROUP BY term),
wanted AS (SELECT item_id, unnest(list_distinct({_TERMS.format('text')})) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2 / (tf + (1 - 0.75 + 0.75 * length / average))), 6) AS score, count(*) AS hits
  FROM wanted JOIN df USING (term) JOIN idx USING (term) JOIN len USING (doc_id), stat GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def plain_terms(text):
    """Terms without stems, of a null text none."""
    return F.coalesce(terms(text), F.array().cast("array<string>"))


def plain_index(spark, d):
    """The index of documents by plain terms, kept for the table as it is."""
    rows = blocks.kept(spark, f"{d}/documents.parquet", "plain", lambda docs: blocks.build(docs, analyse=plain_terms))
    return blocks.opened(rows, analyse=plain_terms)


def best_documents(spark, d, k):
    """(index, weighed items, the k best documents of each item)."""
    index = plain_index(spark, d)
    told = blocks.weighed(table(spark, d, "benchmark"), index)
    return index, told, blocks.best(told, index, k).withColumnsRenamed({"question": "item_id", "key": "doc_id"})


def _best(spark, d, k):
    return best_documents(spark, d, k)[-1]


@query("X3 X4 A6 A7 A8 J18 R1 R2 T1 T2", f"WITH {INDEX_SQL} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return _best(spark, d, 10).select("item_id", "doc_id", "score", "rank")


@query("A6", f"WITH {INDEX_SQL} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stat")
def document_frequency(spark, d):
    index = search.postings(table(spark, d, "documents"))
    df, n, _ = search.statistics(index)
    return df.select("term", F.col("df").cast("long").alias("df"), F.round(search.idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


@query("F2 R3 W1", f"""WITH {INDEX_SQL}, named AS (SELECT item_id, r.doc_id, source,
  round(score * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.55 END * CASE WHEN n_chars < 200 THEN 0.9 ELSE 1.0 END, 6) AS score FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 200),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS k FROM named)
SELECT item_id, doc_id, source, score FROM best WHERE k = 1""")
def rerank_best_per_source(spark, d):
    docs = table(spark, d, "documents")
    top = _best(spark, d, 200).join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    factor = F.when(F.col("lang") == "en", 1.0).otherwise(0.55) * F.when(F.col("n_chars") < 200, 0.9).otherwise(1.0)
    top = top.withColumn("score", F.round(F.col("score") * factor, 6))
    k = F.row_number().over(Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id"))
    return top.withColumn("k", k).where("k = 1").select("item_id", "doc_id", "source", "score")


@query("F3", f"WITH {INDEX_SQL}, own AS (SELECT item_id, doc_id, score FROM scored JOIN documents USING (doc_id) WHERE lang = 'en' AND source = 'src0') SELECT item_id, doc_id, score FROM own QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5")
def strict_scope_topk(spark, d):
    """The best within a scope: only its documents are ranked, by the frequencies and lengths of all."""
    index = plain_index(spark, d)
    told = blocks.weighed(table(spark, d, "benchmark"), index)
    scope = blocks.build(table(spark, d, "documents").where("lang = 'en' AND source = 'src0'"), analyse=plain_terms)
    found = blocks.best(told, replace(index, rows=scope), 5)
    return found.select(F.col("question").alias("item_id"), F.col("key").alias("doc_id"), "score")


@query("A9 R5 Q6", f"""WITH {INDEX_SQL}, best AS (SELECT * FROM ranked WHERE rank = 1),
second AS (SELECT item_id, score AS runner FROM ranked WHERE rank = 2),
w AS (SELECT item_id, term, ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5)) AS idf FROM wanted LEFT JOIN df USING (term), stat),
c AS (SELECT w.item_id, sum(CASE WHEN i.term IS NOT NULL THEN idf ELSE 0 END) / sum(idf) AS coverage, sum(CASE WHEN i.term IS NOT NULL THEN idf ELSE 0 END) AS mass
  FROM w LEFT JOIN best b USING (item_id) LEFT JOIN idx i ON i.doc_id = b.doc_id AND i.term = w.term GROUP BY w.item_id)
SELECT item_id, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.66 OR (coverage >= 0.4 AND mass >= 18) THEN 'answer' ELSE 'no_evidence' END AS status,
 CASE WHEN coverage >= 0.85 AND score >= 1.15 * coalesce(runner, 0) THEN 'high' WHEN coverage >= 0.75 THEN 'medium' ELSE 'low' END AS confidence
FROM c LEFT JOIN best USING (item_id) LEFT JOIN second USING (item_id)""")
def answer_gate(spark, d):
    index, told, top = best_documents(spark, d, 2)
    first = blocks.evidence(top.where("rank = 1"), told, index).select("number", "score", "matched")
    words = told.where("weights IS NOT NULL").join(first, "number", "left")
    mass = F.aggregate("weights", F.lit(0.0), lambda a, w: a + F.when(F.array_contains("matched", w["term"]), w["idf"]).otherwise(0.0))
    whole = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w["idf"])
    c = words.select("number", F.col("question").alias("item_id"), "score", mass.alias("mass"), (mass / whole).alias("coverage"))
    c = c.join(top.where("rank = 2").select("number", F.col("score").alias("runner")), "number", "left")
    enough = (F.col("coverage") >= 0.66) | ((F.col("coverage") >= 0.4) & (F.col("mass") >= 18))
    sure = (F.col("coverage") >= 0.85) & (F.col("score") >= 1.15 * F.coalesce("runner", F.lit(0.0)))
    return c.select(
        "item_id",
        F.round("coverage", 6).alias("coverage"),
        F.when(enough, "answer").otherwise("no_evidence").alias("status"),
        F.when(sure, "high").when(F.col("coverage") >= 0.75, "medium").otherwise("low").alias("confidence"),
    )


@query("W5 W21", f"WITH {INDEX_SQL} SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 4) AS share, round(score - lead(score) OVER (PARTITION BY item_id ORDER BY rank), 6) AS margin FROM ranked WHERE rank <= 20")
def share_of_best(spark, d):
    top = _best(spark, d, 20)
    own = Window.partitionBy("item_id")
    return top.select("item_id", "doc_id", F.round(F.col("score") / F.max("score").over(own), 4).alias("share"), F.round(F.col("score") - F.lead("score").over(own.orderBy("rank")), 6).alias("margin"))


@query("J13 J14", f"""WITH rules(trigger, extra) AS (VALUES ('the the', 'and'), ('than', 'that'), ('than', 'then')),
q AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS words FROM benchmark)
SELECT item_id, trigger, string_agg(extra, '|' ORDER BY extra) AS extras FROM q JOIN rules ON contains(words, ' ' || trigger || ' ') GROUP BY item_id, trigger""")
def synonym_triggers(spark, d):
    from millrace.functions.text import raw_tokens

    rules = spark.createDataFrame([("the the", "and"), ("than", "that"), ("than", "then")], "trigger string, extra string")
    q = table(spark, d, "benchmark").select("item_id", F.concat(F.lit(" "), F.array_join(raw_tokens(F.col("text")), " "), F.lit(" ")).alias("words"))
    hit = q.join(F.broadcast(rules), F.col("words").contains(F.concat(F.lit(" "), "trigger", F.lit(" "))))
    return hit.groupBy("item_id", "trigger").agg(F.array_join(F.array_sort(F.collect_list("extra")), "|").alias("extras"))


_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query("J12 R20", f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_NORM.format('d.text')}, {_NORM.format('b.text')})")
def containment_gold(spark, d):
    """Items found word for word in documents, blocked on their rarest inner word."""
    return gold(table(spark, d, "benchmark"), table(spark, d, "documents"))


def gold(items, docs):
    """(item_id, doc_id) where the document holds the item's squashed text. Documents are counted for each inner word of an item;
    those with its rarest one are fetched and searched. An item without an inner word may begin and end inside other words,
    so it is found by its first letters instead, among those of every place in a text."""
    inner = F.slice(F.split(squash(F.col("text")), " "), 2, 1 << 30)  # the first and last word may be part of longer ones
    inner = F.array_distinct(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))))
    asked = items.select("item_id", squash(F.col("text")).alias("item"), inner.alias("inner")).where("item IS NOT NULL")
    bodies = docs.select("doc_id", squash(F.col("text")).alias("body"))
    words = asked.select("item", F.explode("inner").alias("word")).distinct()
    held = bodies.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    counts = words.join(held.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rarest = counts.groupBy("item").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    small = stored(asked.drop("inner").join(rarest, "item", "left").withColumn("word", F.coalesce("word", F.lit(""))), "asked")

    def found(keyed, keys):
        met = keys.join(keyed.select("word").distinct(), "word", "left_semi").join(keyed.select("word", "item_id", "item"), "word")
        return met.join(bodies, "doc_id").where(F.col("body").contains(F.col("item"))).select("item_id", "doc_id")

    whole = small.where("word != ''")
    out = found(whole, bodies.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word")))
    short = small.where("word = '' AND item != ''").withColumn("word", F.substring("item", 1, 3))
    for size in (1, 2, 3):
        own = short.where(F.length("word") == size)
        if own.head(1):  # items are questions: a small table
            places = F.sequence(F.lit(1), F.greatest(F.length("body") - size + 1, F.lit(1)))
            grams = F.array_distinct(F.transform(places, lambda i, size=size: F.substring("body", i, F.lit(size))))
            out = out.unionByName(found(own, bodies.select("doc_id", F.explode(grams).alias("word"))))
    if items.where(squash(F.col("text")) == "").head(1):
        blank = items.where(squash(F.col("text")) == "").agg(F.collect_list("item_id").alias("ids"))
        out = out.unionByName(bodies.where("body IS NOT NULL").select("doc_id", F.lit(0).alias("k")).join(blank.withColumn("k", F.lit(0)), "k").select(F.explode("ids").alias("item_id"), "doc_id"))
    return out.distinct()


@query("R6 T4 W21", f"""WITH q AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS term FROM benchmark),
s AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, unnest(list_distinct({_TERMS.format('line')})) AS term FROM s),
h AS (SELECT doc_id, pos, count(*) AS hits FROM t JOIN q USING (term) GROUP BY doc_id, pos),
b AS (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS best FROM h),
k AS (SELECT doc_id, pos, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS r FROM b WHERE hits >= 0.45 * best)
SELECT doc_id, pos::INTEGER AS pos, hits FROM k WHERE r <= 3""")
def extract_lines(spark, d):
    """The lines of each document with most of the questions' terms: the best three of those near the best, in text order."""
    q = table(spark, d, "benchmark").select(F.explode(terms(F.col("text"))).alias("term")).distinct()
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = lines.select("doc_id", (F.col("pos") + 1).alias("pos"), F.explode(F.array_distinct(terms(F.col("line")))).alias("term"))
    h = t.join(q, "term", "left_semi").groupBy("doc_id", "pos").agg(F.count("*").alias("hits"))
    own = Window.partitionBy("doc_id")
    near = h.withColumn("best", F.max("hits").over(own)).where("hits >= 0.45 * best")
    return near.withColumn("r", F.row_number().over(own.orderBy(F.desc("hits"), "pos"))).where("r <= 3").select("doc_id", "pos", "hits")
