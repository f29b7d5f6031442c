"""Queries of windows, runs, ranks and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import in_order
from millrace.operators import sequences as S
from millrace.registry import query, table


@query("W2 W23", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def keep_largest(spark, d):
    return S.first_of_each(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("W23", "SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def duplicate_of(spark, d):
    """Equal texts name their smallest doc_id. Joined back on the hash, so that a text of very many copies is no window."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "sha").select("doc_id", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"))


@query("W3 W22", "SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def dialogue_state(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    user = F.when(F.col("role") == "user", F.col("turn"))
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous"), F.lead("role").over(w).alias("next"), F.last(user, ignorenulls=True).over(before).alias("last_user"))


@query("W4 W20 X44", "SELECT o_orderkey, 'ORD:' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::VARCHAR, 6, '0') AS number, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') AS slug FROM orders")
def running_number(spark, d):
    from millrace.functions.text import slug

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.format_string("ORD:%06d", k).alias("number"), slug(F.col("o_orderpriority")).alias("slug"))


@query("W7 W6", """WITH x AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x) SELECT user_id, island::BIGINT AS island, min(ts) AS first, max(ts) AS last, count(*) AS n FROM y GROUP BY user_id, island""")
def sessions(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("before", F.lag("ts").over(w))
    late = F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL '6' HOUR"))
    x = S.islands(e, ["user_id"], ["ts", "event_id"], late)
    return x.groupBy("user_id", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query("W19 A31", "WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), y AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS run FROM x) SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last, count(*) AS size FROM y GROUP BY l_suppkey, run")
def page_runs(spark, d):
    return S.consecutive(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query("W8 W9", "SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS head FROM orders")
def inherited_head(spark, d):
    o = table(spark, d, "orders").withColumn("head", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")))
    return S.fill_forward(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "head").select("o_orderkey", "head")


@query("W13", "WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE top IS NULL OR o_totalprice > top")
def monotone_filter(spark, d):
    return S.monotone(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey")


@query("W14", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < lag(l_shipdate) OVER w THEN 'BACKWARD' WHEN l_quantity > 10 + lag(l_quantity) OVER w THEN 'JUMP' ELSE 'OK' END AS state FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)")
def order_checks(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    state = F.when(F.col("l_shipdate") < F.lag("l_shipdate").over(w), "BACKWARD").when(F.col("l_quantity") > 10 + F.lag("l_quantity").over(w), "JUMP").otherwise("OK")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"))


@query("W15", """WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INTEGER, l_linenumber) AS k, l_quantity::INTEGER AS s, (l_quantity + l_linenumber * 4)::INTEGER AS e FROM lineitem),
f(l_orderkey, k, s, e, kept, last) AS (SELECT l_orderkey, k, s, e, TRUE, e FROM s WHERE k = 1 UNION ALL SELECT s.l_orderkey, s.k, s.s, s.e, s.s >= f.last, CASE WHEN s.s >= f.last THEN s.e ELSE f.last END FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.k = f.k + 1)
SELECT l_orderkey, s, e FROM f WHERE kept""")
def span_allocation(spark, d):
    q = F.col("l_quantity")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(q.cast("int").alias("s"), F.col("l_linenumber").alias("k"), (q + F.col("l_linenumber") * 4).cast("int").alias("e")))).alias("x"))
    spans = F.transform("x", lambda v: F.struct(v.s.alias("s"), v.e.alias("e")))
    return x.select("l_orderkey", F.inline(in_order(spans)))


@query("W17 T6", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity END AS q FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(q, (lag(q) OVER w + lead(q) OVER w) / 2) AS q FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)")
def infer_missing(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", F.when(F.col("l_linenumber") % 3 != 2, F.col("l_quantity")).alias("q"))
    return x.select("l_orderkey", "l_linenumber", F.coalesce("q", (F.lag("q").over(w) + F.lead("q").over(w)) / 2).alias("q"))


@query("W12 X27")
def longest_increasing_lines(spark, d):
    """Per order, the line numbers of one longest increasing run of ship dates."""
    return S.longest_increasing(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate")


@query("W10 W11 U1")
def packed_passages(spark, d):
    return S.passages(table(spark, d, "documents"))


@query("T3", "SELECT p_partkey, row_number() OVER (ORDER BY (p_partkey % 12), (p_partkey % 100), p_partkey) AS place FROM part")
def natural_order(spark, d):
    """Numbers like 10.9 sort by their parts, not as strings."""
    k = F.col("p_partkey")
    number = F.concat_ws(".", k % 12, k % 100)
    parts = F.transform(F.split(number, r"\."), lambda x: x.try_cast("int"))
    return S.numbered(table(spark, d, "part").select("p_partkey", parts.alias("parts")), ["parts", "p_partkey"], "place").select("p_partkey", "place")


@query("T5", "WITH x AS (SELECT n_regionkey, c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT n_regionkey, c_custkey FROM x WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) <= 8")
def capped_per_group(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    x = table(spark, d, "customer").join(n, "c_nationkey")
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    x = x.withColumn("k", k).where("k <= 2")
    m = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return x.withColumn("m", m).where("m <= 8").select("n_regionkey", "c_custkey")


@query("T6", "WITH x AS (SELECT a.p_partkey, b.p_retailprice AS other, abs(ln(b.p_retailprice / a.p_retailprice)) AS dist FROM part a JOIN (SELECT DISTINCT p_brand, p_retailprice FROM part) b ON a.p_brand = b.p_brand AND a.p_retailprice <> b.p_retailprice) SELECT p_partkey, other FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY round(dist, 9), other) <= 3")
def distractors(spark, d):
    """The three nearest are among the three prices before and the three after in the order of a brand's prices."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    w = Window.partitionBy("p_brand").orderBy("p_retailprice")
    beside = F.array_compact(F.array(*(f("p_retailprice", k).over(w) for f in (F.lag, F.lead) for k in (1, 2, 3))))
    prices = p.select("p_brand", "p_retailprice").distinct().withColumn("beside", beside)
    dist = lambda o: F.round(F.abs(F.log(o / F.col("p_retailprice"))), 9)
    best = F.slice(F.array_sort(F.transform("beside", lambda o: F.struct(dist(o).alias("dist"), o.alias("other")))), 1, 3)
    prices = prices.select("p_brand", "p_retailprice", F.explode(best).alias("best"))
    return p.join(prices, ["p_brand", "p_retailprice"]).select("p_partkey", F.col("best.other").alias("other"))


@query("T7", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) <= 5")
def stratified_sample(spark, d):
    """A seeded sample of five per segment, by hash order, so that any engine draws the same rows."""
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.sha2(F.concat(F.lit("7:"), "c_custkey"), 256), "c_custkey"))
    return table(spark, d, "customer").withColumn("k", k).where("k <= 5").select("c_mktsegment", "c_custkey")


@query("T8", "SELECT item_id, CASE WHEN list_sum([instr('0123456789abcdef', c) - 1 FOR c IN str_split(sha256(text), '')]) % 3 = 0 THEN 'test' ELSE 'dev' END AS split FROM benchmark")
def hash_split(spark, d):
    digits = F.filter(F.split(F.sha2("text", 256), ""), lambda c: c != "")
    total = F.aggregate(digits, F.lit(0), lambda acc, c: acc + F.conv(c, 16, 10).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.when(total % 3 == 0, "test").otherwise("dev").alias("split"))


@query("T9 T10", "SELECT p_partkey, string_agg(o, '|' ORDER BY sha256(p_partkey || ':' || o)) AS options FROM (SELECT p_partkey, unnest(['red', 'green', 'blue', p_brand]) AS o FROM part) GROUP BY p_partkey")
def shuffled_options(spark, d):
    options = F.array(F.lit("red"), F.lit("green"), F.lit("blue"), F.col("p_brand"))
    keyed = F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), o), 256).alias("h"), o.alias("o"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(keyed, lambda x: x.o), "|").alias("options"))


@query("T11 A35", "WITH s AS (SELECT user_id, count(*) AS seen, least(5, count(*) FILTER (event_type = 'purchase')) AS box FROM events GROUP BY 1) SELECT user_id, box, seen FROM s ORDER BY box, seen, sha256(user_id::VARCHAR) LIMIT 20")
def leitner_pick(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("seen"), F.least(F.lit(5).cast("long"), F.count_if(F.col("event_type") == "purchase")).alias("box"))
    return s.orderBy("box", "seen", F.sha2(F.col("user_id").cast("string"), 256)).limit(20).select("user_id", "box", "seen")
