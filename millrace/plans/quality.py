"""Constraint queries: each gives the rows that break a rule, named by the rule and the row's key."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from millrace.functions.text import squash
from millrace.operators import quality as Q
from millrace.operators import ratchet
from millrace.operators.stored import shared_folder, stored
from millrace.registry import query, table


@query("C1", "SELECT 'c_mktsegment not in list' AS rule, c_custkey AS key FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') UNION ALL SELECT 'c_acctbal out of range', c_custkey FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000 UNION ALL SELECT 'c_name has no match', c_custkey FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')")
def schema_violations(spark, d):
    rules = {"c_mktsegment not in list": ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "c_acctbal out of range": ~F.col("c_acctbal").between(0, 9000), "c_name has no match": ~F.col("c_name").rlike("[0-4]$")}
    return Q.violations(table(spark, d, "customer"), "c_custkey", rules)


_GRAPH = "n AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey FROM supplier), e AS (SELECT o_orderkey AS k, o_custkey AS src, o_orderkey % 1500 AS dst, o_orderstatus AS rel FROM orders)"


@query("C2 C3 C18", f"""WITH {_GRAPH} SELECT 'duplicate key' AS rule, id AS key FROM n GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'dangling from', k FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'dangling to', k FROM e WHERE dst NOT IN (SELECT id FROM n)
UNION ALL SELECT 'invalid relationship', k FROM e WHERE rel NOT IN ('F', 'O') UNION ALL SELECT 'edge to itself', k FROM e WHERE src = dst
UNION ALL SELECT 'duplicate edge', min(k) FROM e GROUP BY src, dst, rel HAVING count(*) > 1
UNION ALL SELECT 'duplicate identity', min(doc_id) FROM documents GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) HAVING count(*) > 1""")
def graph_violations(spark, d):
    """Rules of a graph: nodes known once, edges between known nodes, of a known kind, each once, and documents of one text."""
    nodes = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").select("s_suppkey"))
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst"), F.col("o_orderstatus").alias("rel"))
    named = lambda df, rule: df.withColumn("rule", F.lit(rule))
    ends = [named(Q.dangling(edges, "k", end, nodes, "id"), f"dangling {side}") for end, side in (("src", "from"), ("dst", "to"))]
    rows = Q.violations(edges, "k", {"invalid relationship": ~F.col("rel").isin("F", "O"), "edge to itself": F.col("src") == F.col("dst")})
    twice = Q.repeated(edges, ["src", "dst", "rel"], "k", "duplicate edge")
    same = Q.repeated(table(spark, d, "documents").select("doc_id", F.sha2(squash(F.col("text")), 256).alias("identity")).where("identity IS NOT NULL"), ["identity"], "doc_id", "duplicate identity")
    return reduce(lambda a, b: a.unionByName(b), [Q.duplicates(nodes, "id"), *ends, rows, twice, same])


@query("C4", """SELECT 'no document' AS rule, doc_id AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'not in list', doc_id FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'short evidence', l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND n_chars < 60 UNION ALL SELECT 'length differs', doc_id FROM documents WHERE n_chars <> length(text) OR text = ''""")
def evidence_violations(spark, d):
    """Labels as evidence: of a document that exists, of a known value, on text enough; and documents as long as they say."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    none = labels.join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("no document").alias("rule"), F.col("doc_id").alias("key"))
    known = Q.violations(labels, "doc_id", {"not in list": ~(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))})
    short = Q.violations(labels.join(docs.select("doc_id", "n_chars"), "doc_id"), "doc_id", {"short evidence": (F.col("quality") == 1) & (F.col("n_chars") < 60)})
    length = Q.violations(docs, "doc_id", {"length differs": (F.col("n_chars") != F.length("text")) | (F.col("text") == "")})
    return reduce(lambda a, b: a.unionByName(b), [none, known, short, length])


@query("C16", """WITH a AS (SELECT doc_id FROM documents WHERE n_chars >= 40), b AS (SELECT doc_id FROM labels)
SELECT 'only in first' AS rule, doc_id AS key FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT 'only in second', doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT 'question without words', item_id FROM benchmark WHERE NOT regexp_matches(text, '[A-Za-z]{12}')""")
def index_violations(spark, d):
    """An index holds just the documents that belong in it, and every question has words to look for."""
    stores = Q.set_difference(table(spark, d, "documents").where("n_chars >= 40"), table(spark, d, "labels"), "doc_id")
    return stores.unionByName(Q.violations(table(spark, d, "benchmark"), "item_id", {"question without words": ~F.col("text").rlike("[A-Za-z]{12}")}))


@query("C5 C14 S7", "SELECT 'missing' AS rule, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 20) UNION ALL SELECT 'unexpected', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def coverage_violations(spark, d):
    p, line = table(spark, d, "part"), table(spark, d, "lineitem")
    have = line.where("l_quantity > 20").select(F.col("l_partkey").alias("p_partkey"))
    missing = p.join(have, "p_partkey", "left_anti").select(F.lit("missing").alias("rule"), F.col("p_partkey").alias("key"))
    extra = line.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().join(p.where("p_size < 40").select("p_partkey"), "p_partkey", "left_anti")
    return missing.unionByName(extra.select(F.lit("unexpected").alias("rule"), F.col("p_partkey").alias("key")))


@query("C8 W14", "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders) SELECT 'order dates go back' AS rule, o_orderkey AS key FROM s WHERE after < o_orderdate")
def order_violations(spark, d):
    return Q.backward(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate", "order dates go back")


@query("C11", "SELECT CASE WHEN l_tax > l_discount THEN 'bounds reversed' END AS rule, l_orderkey * 10 + l_linenumber AS key FROM lineitem WHERE l_tax > l_discount UNION ALL SELECT 'not in unit list', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def measurement_violations(spark, d):
    line = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Q.violations(line, "key", {"bounds reversed": F.col("l_tax") > F.col("l_discount"), "not in unit list": ~F.col("l_returnflag").isin("A", "N")})


@query("C12 C13", """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS cells FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS head, max(l_linenumber) AS last, min(cells) AS low, max(cells) AS high FROM c GROUP BY 1)
SELECT unnest(list_filter([CASE WHEN n > 6 THEN 'row count' END, CASE WHEN low <> high THEN 'not rectangular' END, CASE WHEN head > 2 THEN 'header out of range' END, CASE WHEN last - head + 1 <> n THEN 'numbering gap' END], lambda x: x IS NOT NULL)) AS rule, l_orderkey AS key FROM r
UNION ALL SELECT 'dangling', l_orderkey FROM r WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def table_violations(spark, d):
    """The lines of an order as a table: rectangular, numbered without a gap, its header at the top, owned by an order that counts."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("cells"))
    r = c.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("head"), F.max("l_linenumber").alias("last"), F.min("cells").alias("low"), F.max("cells").alias("high"))
    rules = {"row count": F.col("n") > 6, "not rectangular": F.col("low") != F.col("high"), "header out of range": F.col("head") > 2, "numbering gap": F.col("last") - F.col("head") + 1 != F.col("n")}
    return Q.violations(r, "l_orderkey", rules).unionByName(Q.dangling(r, "l_orderkey", "l_orderkey", table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey"))


@query("C19", "SELECT 'edge leaves its region' AS rule, o_orderkey AS key FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY o_orderkey")
def isolation_violations(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("ra"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("rb"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    x = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey").join(s, "l_suppkey").where("ra <> rb")
    return x.select(F.lit("edge leaves its region").alias("rule"), F.col("l_orderkey").alias("key")).distinct()


@query("C17 A34", "WITH v AS (SELECT 'segment' AS gate, count(*) AS n FROM customer WHERE c_mktsegment IS NULL UNION ALL SELECT 'price', count(*) FROM part WHERE p_retailprice <= 0 UNION ALL SELECT 'long', count(*) FROM documents WHERE n_chars > 5000) SELECT gate, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v")
def gate_report(spark, d):
    gates = {"segment": table(spark, d, "customer").where("c_mktsegment IS NULL"), "price": table(spark, d, "part").where("p_retailprice <= 0"), "long": table(spark, d, "documents").where("n_chars > 5000")}
    rows = [df.agg(F.lit(name).alias("gate"), F.count("*").alias("n")) for name, df in gates.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


@query("C7 C16 C18 K9", """WITH m AS (SELECT median(event_id) AS mid FROM events), c AS (SELECT rule, count(*) FILTER (event_id < mid) AS a, count(*) FILTER (event_id >= mid) AS b FROM (SELECT event_id, event_type || CASE WHEN value > 80 THEN ' over 80' ELSE ' in bounds' END AS rule FROM events), m GROUP BY rule)
SELECT rule, CASE WHEN a > 0 THEN a END AS before, b AS now, CASE WHEN a = 0 THEN 'new' WHEN b > a THEN 'worse' WHEN b < a THEN 'better' ELSE 'same' END AS status FROM c""")
def event_ratchet(spark, d):
    """Counts of the later half of events against the baseline that the earlier half has left."""
    e = table(spark, d, "events")
    mid = e.agg(F.median("event_id")).first()[0]
    rule = F.concat("event_type", F.when(F.col("value") > 80, " over 80").otherwise(" in bounds"))
    counted = lambda half: half.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))
    path = f"{shared_folder(spark)}/ratchet-{uuid.uuid4().hex}"
    ratchet.advance(ratchet.compared(ratchet.baseline(spark, path), counted(e.where(F.col("event_id") < mid))), path)
    return ratchet.compared(ratchet.baseline(spark, path), counted(e.where(F.col("event_id") >= mid)))


@query("C10 C7 C4", """WITH RECURSIVE x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) - 1 AS place FROM documents)
SELECT CASE WHEN place % 5 = 3 THEN 'missing' ELSE 'differs' END AS rule, doc_id, place::INTEGER AS place FROM x WHERE place % 5 = 3 OR place % 7 = 6
UNION ALL SELECT 'stale', doc_id, max(place)::INTEGER + 1 FROM x GROUP BY doc_id HAVING max(place) % 2 = 0""")
def fresh_extraction(spark, d):
    """What the gate of a fresh extraction says of kept numbers of documents, of which some were lost, changed and added."""
    docs = table(spark, d, "documents")
    numbers = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("place", "raw"))
    lost = numbers.where("place % 5 != 3").withColumn("raw", F.when(F.col("place") % 7 == 6, F.concat("raw", F.lit("0"))).otherwise(F.col("raw")))
    more = numbers.groupBy("doc_id").agg(F.max("place").alias("place")).where("place % 2 = 0").select("doc_id", (F.col("place") + 1).alias("place"), F.lit("1").alias("raw"))
    kept = stored(lost.unionByName(more), "kept")
    return ratchet.reextracted(kept, numbers, ["doc_id", "place"], "raw")
