"""Queries of evaluation, review, feedback and agreement."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import joins
from millrace.plans.retrieval import _NORM, INDEX_SQL, best_documents, gold
from millrace.registry import query, table

_GOLD = f"gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_NORM.format('d.text')}, {_NORM.format('b.text')}))"


@query("A15 A3 R25", f"""WITH {INDEX_SQL}, {_GOLD}, hit AS (SELECT item_id, min(rank) AS rank FROM ranked JOIN gold USING (item_id, doc_id) WHERE rank <= 10 GROUP BY 1),
q AS (SELECT b.item_id, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS category, rank FROM benchmark b LEFT JOIN hit USING (item_id) WHERE item_id IN (SELECT item_id FROM gold))
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 3) AS r1, round(avg((coalesce(rank, 99) <= 3)::INT), 3) AS r3, round(avg((coalesce(rank, 99) <= 5)::INT), 3) AS r5, round(avg((coalesce(rank, 99) <= 10)::INT), 3) AS r10, round(avg(coalesce(1.0 / rank, 0)), 3) AS mrr
FROM q GROUP BY GROUPING SETS ((category), ())""")
def recall_and_mrr(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = best_documents(spark, d, 10)[-1]
    right = gold(items, docs)
    hit = top.join(right, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("rank"))
    q = items.join(right.select("item_id").distinct(), "item_id", "left_semi").join(hit, "item_id", "left")
    q = q.select(F.when(F.length("text") < 200, "short").otherwise("long").alias("category"), "rank")
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")), 3).alias(f"r{k}")
    out = q.groupingSets([["category"], []], "category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"), at(1), at(3), at(5), at(10), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n", "r1", "r3", "r5", "r10", "mrr")


@query("A16", """WITH s AS (SELECT quality = 1 AS good, least(1.0, n_chars / 4000.0) AS x FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest(generate_series(0, 50)) AS k),
b AS (SELECT k, avg((x >= k / 50.0)::INT) FILTER (good) AS tpr, avg((x < k / 50.0)::INT) FILTER (NOT good) AS tnr FROM s, t GROUP BY k)
SELECT k, round((tpr + tnr) / 2, 6) AS balanced FROM b ORDER BY balanced DESC, k LIMIT 1""")
def threshold_scan(spark, d):
    """The threshold, of 51, with the best balanced accuracy. Scores are counted in cells first, so nothing is crossed."""
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    cell = F.expr("CAST(least(n_chars div 80, 50) AS INT)")  # the last threshold k / 50 that n_chars / 4000 reaches
    c = s.groupBy(cell.alias("cell")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    both = c.unionByName(spark.range(51).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))).groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    w = Window.orderBy("cell")
    up, down = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    tpr = F.sum("good").over(up) / F.sum("good").over(every)
    tnr = F.coalesce(F.sum("bad").over(down), F.lit(0)) / F.sum("bad").over(every)
    return both.select(F.col("cell").cast("long").alias("k"), F.round((tpr + tnr) / 2, 6).alias("balanced")).orderBy(F.desc("balanced"), "k").limit(1)


@query("A17", """WITH s AS (SELECT source, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM labels JOIN documents USING (doc_id) GROUP BY source), p AS (SELECT *, k / n AS p FROM s)
SELECT source, n::BIGINT AS n, round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 3) AS low, round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 3) AS high FROM p""")
def wilson_by_source(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return s.select("source", "n", F.round(stats.wilson(k, n, False), 3).alias("low"), F.round(stats.wilson(k, n, True), 3).alias("high"))


@query("A18", "WITH s AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), m AS (SELECT avg(a::INT) AS pa, avg(b::INT) AS pb, avg((a = b)::INT) AS po FROM s) SELECT round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM m")
def kappa(spark, d):
    return table(spark, d, "labels").agg(F.round(stats.kappa(F.col("quality") == 1, F.col("toxic") == 1), 6).alias("kappa"))


@query("A19 A20 C6 R23", """WITH r AS (SELECT user_id % 40 AS target, user_id AS reviewer, event_type IN ('click', 'purchase', 'view') AS ok FROM events WHERE event_type <> 'signup'),
f AS (SELECT target, count(DISTINCT reviewer) FILTER (ok) AS approvers, bool_or(NOT ok) AS bad, count(DISTINCT reviewer) AS reviewers, count(DISTINCT ok) AS decisions FROM r GROUP BY 1)
SELECT target, CASE WHEN bad THEN 'disputed' WHEN approvers >= 2 THEN 'verified' WHEN approvers = 1 THEN 'reviewed' ELSE 'unreviewed' END AS status, reviewers >= 2 AND decisions = 1 AS agreed FROM f""")
def review_status(spark, d):
    e = table(spark, d, "events").where("event_type <> 'signup'")
    ok = F.col("event_type").isin("click", "purchase", "view")
    r = e.select((F.col("user_id") % 40).alias("target"), F.col("user_id").alias("reviewer"), ok.alias("ok"))
    f = r.groupBy("target").agg(F.countDistinct(F.when(F.col("ok"), F.col("reviewer"))).alias("approvers"), F.bool_or(~F.col("ok")).alias("bad"), F.countDistinct("reviewer").alias("reviewers"), F.countDistinct("ok").alias("decisions"))
    status = F.when(F.col("bad"), "disputed").when(F.col("approvers") >= 2, "verified").when(F.col("approvers") == 1, "reviewed").otherwise("unreviewed")
    return f.select("target", status.alias("status"), ((F.col("reviewers") >= 2) & (F.col("decisions") == 1)).alias("agreed"))


@query("A21 R29", "SELECT lower(trim(props)) AS asked, count(*) AS n, min(ts) AS first FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, asked LIMIT 50")
def knowledge_gaps(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.lower(F.trim("props")).alias("asked")).agg(F.count("*").alias("n"), F.min("ts").alias("first")).orderBy(F.desc("n"), "asked").limit(50)


@query("R21 K3", "SELECT DISTINCT substr(sha1(event_type || ':' || user_id), 1, 8) AS review_id, CASE event_type WHEN 'error' THEN 'gap' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'HIGH' ELSE 'candidate' END AS kind FROM events")
def feedback_routes(spark, d):
    """Eight digits of a hash stand for an event's kind and user; where two of different kinds share them, both rows stay."""
    kind = F.when(F.col("event_type") == "error", "gap").when(F.col("event_type") == "view", "low").when(F.col("event_type") == "signup", "HIGH").otherwise("candidate")
    return table(spark, d, "events").select(F.substring(F.sha1(F.concat("event_type", F.lit(":"), "user_id")), 1, 8).alias("review_id"), kind.alias("kind")).distinct()


@query("R22 F18", "WITH r AS (SELECT p_partkey, CASE WHEN p_size < 3 THEN 'too_few' WHEN p_brand IS NULL THEN 'no_reviewer' WHEN p_retailprice < 910 THEN 'no_evidence' WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN 'duplicate' END AS error FROM part) SELECT coalesce(error, 'ok') AS state, count(*) AS n, (SELECT bool_and(error IS NULL) FROM r) AS all_ok FROM r GROUP BY 1")
def proposal_checks(spark, d):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    error = F.when(F.col("p_size") < 3, "too_few").when(F.col("p_brand").isNull(), "no_reviewer").when(F.col("p_retailprice") < 910, "no_evidence").when(k > 1, "duplicate")
    r = table(spark, d, "part").select(error.alias("error"))
    states = r.groupBy(F.coalesce("error", F.lit("ok")).alias("state")).agg(F.count("*").alias("n"))
    return states.withColumn("all_ok", F.min(F.col("state") == "ok").over(Window.partitionBy()))  # a row for each state


@query("R15 R16", """SELECT p_partkey, score, CASE WHEN score >= 1000 THEN 'EXACT_ID' WHEN score >= 250 THEN 'LEXICAL' WHEN score > 0 THEN 'HYBRID' ELSE 'GENERAL' END AS tier FROM (SELECT p_partkey,
 CASE WHEN p_partkey::VARCHAR = '12' THEN 1000 WHEN contains(p_partkey::VARCHAR, '12') THEN 500 ELSE 0 END + CASE WHEN starts_with(lower(p_name), 'a') THEN 400 WHEN contains(lower(p_name), 'a') THEN 250 ELSE 0 END + CASE WHEN contains(lower(p_type), 'e') OR contains(lower(p_brand), '1') THEN 150 ELSE 0 END + least(10 * p_size, 80) AS score FROM part)""")
def layered_ranking(spark, d):
    key, name = F.col("p_partkey").cast("string"), F.lower("p_name")
    a = F.when(key == "12", 1000).when(key.contains("12"), 500).otherwise(0)
    b = F.when(name.startswith("a"), 400).when(name.contains("a"), 250).otherwise(0)
    c = F.when(F.lower("p_type").contains("e") | F.lower("p_brand").contains("1"), 150).otherwise(0)
    score = a + b + c + F.least(F.col("p_size") * 10, F.lit(80))
    tier = F.when(score >= 1000, "EXACT_ID").when(score >= 250, "LEXICAL").when(score > 0, "HYBRID").otherwise("GENERAL")
    return table(spark, d, "part").select("p_partkey", score.alias("score"), tier.alias("tier"))


@query("R27", "WITH c AS (SELECT l_orderkey, l_partkey AS item, 0 AS kind, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_orderkey, l_suppkey, 1, l_linenumber FROM lineitem), u AS (SELECT l_orderkey, item, min(kind * 100 + k) AS p FROM c GROUP BY ALL) SELECT l_orderkey, item FROM u QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p, item) <= 3")
def follow_ups(spark, d):
    line = table(spark, d, "lineitem")
    c = line.where("l_linenumber <= 2").select("l_orderkey", F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("p")).unionByName(line.select("l_orderkey", F.col("l_suppkey").alias("item"), (F.col("l_linenumber") + 100).alias("p")))
    u = c.groupBy("l_orderkey", "item").agg(F.min("p").alias("p"))
    return u.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("p", "item"))).where("k <= 3").select("l_orderkey", "item")


@query("R24 R26", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'NO_CUSTOMER' WHEN n = 0 THEN 'NO_LINES' WHEN n > 5 THEN 'MANY' ELSE 'OK' END AS reason FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN LATERAL (SELECT count(*) AS n FROM lineitem WHERE l_orderkey = o_orderkey) ON TRUE")
def diagnosis(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    x = o.join(c, "o_custkey", "left").join(n, "o_orderkey", "left")
    return x.select("o_orderkey", F.when(F.col("known").isNull(), "NO_CUSTOMER").when(F.coalesce("n", F.lit(0)) == 0, "NO_LINES").when(F.col("n") > 5, "MANY").otherwise("OK").alias("reason"))


@query("R14", "SELECT lang, source, doc_id // 100 AS page, count(*) AS n, string_agg(doc_id || ':' || n_chars, ',' ORDER BY doc_id) AS entries FROM documents GROUP BY ALL")
def browse_tree(spark, d):
    """Documents under language and source, a hundred ids to a page, so that no group grows with the table."""
    x = F.array_sort(F.collect_list(F.struct("doc_id", "n_chars")))
    g = table(spark, d, "documents").groupBy("lang", "source", F.expr("doc_id div 100").alias("page")).agg(F.count("*").alias("n"), x.alias("x"))
    entries = F.array_join(F.transform("x", lambda v: F.concat(v.doc_id.cast("string"), F.lit(":"), v.n_chars.cast("string"))), ",")
    return g.select("lang", "source", "page", "n", entries.alias("entries"))


@query("R9 R7", "WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM l) SELECT doc_id, pos::INTEGER AS pos, CASE WHEN length(label) < 40 THEN label || ': ' || line ELSE line END AS point FROM n WHERE regexp_matches(line, '[0-9]')")
def value_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    label = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    x = lines.withColumn("label", label).where(F.col("line").rlike("[0-9]"))
    return x.select("doc_id", (F.col("pos") + 1).alias("pos"), F.when(F.length("label") < 40, F.concat("label", F.lit(": "), "line")).otherwise(F.col("line")).alias("point"))


@query("R19 F19", "WITH p AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey) AS k FROM part WHERE p_size BETWEEN 8 AND 45) SELECT p_brand, p_partkey, 'Which brand makes ' || p_name || '?' AS front FROM p WHERE k = 1")
def practice_cards(spark, d):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.length("p_name"), "p_partkey"))
    p = table(spark, d, "part").where("p_size BETWEEN 8 AND 45").withColumn("k", k).where("k = 1")
    return p.select("p_brand", "p_partkey", F.concat(F.lit("Which brand makes "), "p_name", F.lit("?")).alias("front"))


@query("R17", "WITH q(word, intent, w) AS (VALUES ('the', 'find', 35), ('that', 'find', 12), ('than', 'compare', 40)), t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM benchmark), s AS (SELECT item_id, intent, sum(w)::BIGINT AS score FROM t JOIN q USING (word) GROUP BY ALL) SELECT item_id, intent, score FROM s WHERE score >= 35 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, intent) = 1")
def curated_match(spark, d):
    q = spark.createDataFrame([("the", "find", 35), ("that", "find", 12), ("than", "compare", 40)], "word string, intent string, w int")
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    s = t.join(F.broadcast(q), "word").groupBy("item_id", "intent").agg(F.sum("w").alias("score")).where("score >= 35")
    return s.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "intent"))).where("k = 1").drop("k")


@query("R13", """WITH own AS (SELECT p_brand, count(*) AS parts, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1),
kind AS (SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1),
m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT a.p_brand AS brand, b.p_brand AS other, count(*) AS support FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.p_brand <> b.p_brand GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT brand, string_agg(other || ':' || support, '|' ORDER BY support DESC, other) AS related FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY brand ORDER BY support DESC, other) <= 3) GROUP BY 1)
SELECT p_brand, p_type AS kind, parts, low, high, related FROM own JOIN kind USING (p_brand) LEFT JOIN r ON brand = p_brand""")
def concept_replies(spark, d):
    """What can be said of each brand as a concept: its main kind, its parts and their limits, and what is most often with it."""
    p = table(spark, d, "part")
    own = p.groupBy("p_brand").agg(F.count("*").alias("parts"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    kind = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_type")).getField("p_type").alias("kind"))
    m = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", F.col("p_brand").alias("brand")).distinct()
    s = joins.pairs_within(m, ["l_orderkey"], "brand", []).groupBy("brand_a", "brand_b").agg(F.count("*").alias("support")).where("support >= 3")
    s = s.select(F.inline(F.array(F.struct(F.col("brand_a").alias("brand"), F.col("brand_b").alias("other"), "support"), F.struct(F.col("brand_b").alias("brand"), F.col("brand_a").alias("other"), "support"))))
    k = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("support"), "other"))
    top = s.withColumn("k", k).where("k <= 3").groupBy(F.col("brand").alias("p_brand")).agg(F.array_sort(F.collect_list(F.struct("k", "other", "support"))).alias("x"))
    related = top.select("p_brand", F.array_join(F.transform("x", lambda v: F.concat(v.other, F.lit(":"), v.support.cast("string"))), "|").alias("related"))
    return own.join(kind, "p_brand").join(related, "p_brand", "left").select("p_brand", "kind", "parts", "low", "high", "related")


@query("R28", """WITH t AS (SELECT o_custkey, o_orderkey, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, o_orderkey, hits, n_rows FROM t WHERE hits >= 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY hits DESC, n_rows, o_orderkey) = 1""")
def owned_table(spark, d):
    """Of the tables that an owner has (the lines of a customer's orders), the one with most matching rows, two at least."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    best = o.join(line.where("hits >= 2"), "o_orderkey").groupBy("o_custkey").agg(F.min(F.struct((-F.col("hits")).alias("h"), "n_rows", "o_orderkey")).alias("b"))
    return best.select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"), (-F.col("b.h")).alias("hits"), F.col("b.n_rows").alias("n_rows"))
