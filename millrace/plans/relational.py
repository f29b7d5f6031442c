"""Queries of joins, filters, aggregates and set operations over the star tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.registry import query, table


@query("J1 J2 J3", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers, coalesce(max(r_name), 'none') AS region FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def dimension_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    out = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    zero = F.lit(0).cast("long")
    return out.select("n_name", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"), F.coalesce("r_name", F.lit("none")).alias("region"))


@query("J4 J5 U3", "SELECT 'with' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_and_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    side = lambda kind, how: c.join(o, "c_custkey", how).agg(F.lit(kind).alias("side"), F.count("*").alias("n"))
    return side("with", "left_semi").unionByName(side("without", "left_anti"))


@query("J6", """SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (
  SELECT o_custkey, o_orderdate + INTERVAL 9000 DAY AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.at""")
def asof_order_of_event(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("who"), "ts")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.expr("o_orderdate + INTERVAL 9000 DAY").alias("at"), "o_orderkey")
    o = o.groupBy("who", "at").agg(F.max("o_orderkey").alias("o_orderkey"))
    return joins.asof(e, o, ["who"], "ts", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


_BANDS = "(VALUES ('tiny', 0, 900), ('small', 800, 1100), ('middle', 1050, 1500), ('large', 1400, 5000)) AS b(band, low, high)"


@query("J7", f"SELECT p_partkey, band FROM part JOIN {_BANDS} ON p_retailprice BETWEEN low AND high")
def price_bands(spark, d):
    bands = spark.createDataFrame([("tiny", 0, 900), ("small", 800, 1100), ("middle", 1050, 1500), ("large", 1400, 5000)], "band string, low int, high int")
    return joins.in_range(table(spark, d, "part"), bands, "p_retailprice", "low", "high", 500).select("p_partkey", "band")


@query("J8 X7", "WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders) SELECT t.o_orderkey, count(*) AS later FROM t JOIN orders o ON o.o_custkey = t.o_custkey AND o.o_orderdate >= t.a AND o.o_orderdate < t.b GROUP BY t.o_orderkey")
def interval_containment(spark, d):
    o = table(spark, d, "orders")
    spans = o.select("o_orderkey", F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("a"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("b"))
    points = o.select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"))
    return spans.join(points, "who").where("at >= a AND at < b").groupBy("o_orderkey").agg(F.count("*").alias("later"))


@query("J10", "SELECT a.p_partkey AS part_a, b.p_partkey AS part_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_size <> b.p_size AND abs(a.p_retailprice - b.p_retailprice) < 200")
def conflicting_parts(spark, d):
    """Parts of one brand and type meet only in cells of price, so that distant ones are never compared."""
    p = joins.pairs_near(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice", 200, ["p_size"])
    return p.where("p_size_a <> p_size_b").select(F.col("p_partkey_a").alias("part_a"), F.col("p_partkey_b").alias("part_b"))


@query("J11 A5 A10 A12 X36", """WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT p_brand, count(*)::DOUBLE AS own FROM m GROUP BY p_brand),
s AS (SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, count(*) AS support FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL HAVING count(*) >= 3)
SELECT brand_a, brand_b, support, round(support / sqrt(x.own * y.own), 6) AS lift FROM s JOIN n x ON x.p_brand = brand_a JOIN n y ON y.p_brand = brand_b""")
def brands_bought_together(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").select("l_orderkey", "brand").distinct()
    own = m.groupBy("brand").agg(F.count("*").alias("own"))
    s = joins.pairs_within(m, ["l_orderkey"], "brand", []).groupBy("brand_a", "brand_b").agg(F.count("*").alias("support")).where("support >= 3")
    for side in "ab":
        s = s.join(own.select(F.col("brand").alias(f"brand_{side}"), F.col("own").alias(f"own_{side}")), f"brand_{side}")
    return s.select("brand_a", "brand_b", "support", F.round(F.col("support") / F.sqrt(F.col("own_a").cast("double") * F.col("own_b")), 6).alias("lift"))


_REF = "(p_partkey % 7)::VARCHAR || '.' || (p_partkey % 5)::VARCHAR || '.' || (p_partkey % 3)::VARCHAR"


@query("J15 J19 J20", f"""WITH r AS (SELECT p_partkey, {_REF} AS ref FROM part), h(head) AS (VALUES ('1'), ('2.1'), ('2.1.0'), ('3'), ('3.4'), ('5.0.2'), ('6'))
SELECT p_partkey, ref, (SELECT max_by(head, length(head)) FROM h WHERE ref = head OR starts_with(ref, head || '.')) AS owner, regexp_replace(ref, '\\.[^.]+$', '') AS parent FROM r""")
def deepest_owner(spark, d):
    k = F.col("p_partkey")
    r = table(spark, d, "part").select("p_partkey", F.concat_ws(".", k % 7, k % 5, k % 3).alias("ref"))
    h = spark.createDataFrame([(x,) for x in ("1", "2.1", "2.1.0", "3", "3.4", "5.0.2", "6")], "head string")
    return joins.longest_prefix(r, h, "ref", "head").withColumn("parent", F.regexp_replace("ref", r"\.[^.]+$", ""))


@query("J16", """WITH c AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS dist FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_nationkey = c_nationkey),
b AS (SELECT *, min(dist) OVER (PARTITION BY c_custkey) AS best FROM c), g AS (SELECT c_custkey, count(DISTINCT s_suppkey) FILTER (dist = best) AS n, min(s_suppkey) FILTER (dist = best) AS s FROM b GROUP BY c_custkey)
SELECT c_custkey, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE n WHEN 1 THEN s END AS s_suppkey FROM g""")
def nearest_supplier(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return joins.nearest(c, s, ["nation"], "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey")


@query("J17", "WITH r AS (SELECT l_orderkey, l_linenumber, unnest(generate_series(l_partkey, l_partkey + l_linenumber)) AS p_partkey FROM lineitem) SELECT p_partkey, count(*) AS n FROM r JOIN part USING (p_partkey) GROUP BY p_partkey")
def expanded_ranges(spark, d):
    r = table(spark, d, "lineitem").select(F.explode(F.sequence("l_partkey", F.col("l_partkey") + F.col("l_linenumber"))).alias("p_partkey"))
    return r.join(table(spark, d, "part").select("p_partkey"), "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("J21 F21", "WITH a(alias, canonical) AS (VALUES ('1-URGENT', 'HIGH'), ('2-HIGH', 'HIGH'), ('5-LOW', 'LOW')) SELECT coalesce(canonical, o_orderpriority) AS priority, count(*) AS n FROM orders LEFT JOIN a ON alias = o_orderpriority GROUP BY 1")
def alias_resolution(spark, d):
    a = spark.createDataFrame([("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("5-LOW", "LOW")], "o_orderpriority string, canonical string")
    o = table(spark, d, "orders").join(F.broadcast(a), "o_orderpriority", "left")
    return o.groupBy(F.coalesce("canonical", "o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("J22", "WITH x AS (SELECT doc_id, unnest(list_zip(str_split(source, ''), str_split(lang, ''))) AS z FROM documents) SELECT doc_id, coalesce(z[1], '') || coalesce(z[2], '') AS pair FROM x")
def positional_zip(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(F.arrays_zip(F.split("source", ""), F.split("lang", ""))).alias("z"))
    return x.select("doc_id", F.concat(F.coalesce("z.0", F.lit("")), F.coalesce("z.1", F.lit(""))).alias("pair"))


@query("A1 A4 A33", "SELECT coalesce(CASE WHEN p_size < 10 THEN NULL ELSE p_brand END, 'unclassified') AS brand, p_type, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY 1, 2")
def counts_with_default(spark, d):
    brand = F.coalesce(F.when(F.col("p_size") >= 10, F.col("p_brand")), F.lit("unclassified")).alias("brand")
    return table(spark, d, "part").groupBy(brand, "p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))


@query("A2 A26", "SELECT lang, count(*) AS total, count(*) FILTER (n_chars < 100) AS short, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def text_measures(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") < 100).alias("short"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("A3", "SELECT CASE WHEN grouping(p_type) = 1 THEN 'ALL' ELSE p_type END AS category, p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand))")
def grouping_sets(spark, d):
    p = table(spark, d, "part").groupingSets([["p_brand", "p_type"], ["p_brand"]], "p_brand", "p_type")
    out = p.agg(F.grouping("p_type").alias("g"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("p_type")).alias("category"), "p_brand", "n", "price")


@query("A11 T12", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS first_three FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3 GROUP BY o_custkey")
def bounded_collect(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, d, "orders").withColumn("k", k).where("k <= 3")
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x.o_orderkey.cast("string")), ",").alias("first_three"))


@query("A13 A14", "SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey")
def latest_and_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_status"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("A25 A28", "SELECT l_returnflag, floor(l_quantity / 10)::BIGINT AS bucket, count(*) AS n, round(100.0 * count(*) FILTER (l_discount > 0.05) / count(*), 1) AS pct FROM lineitem GROUP BY ALL")
def histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("l_discount") > 0.05) * 100.0 / F.count("*"), 1).alias("pct"))


@query("A29", "SELECT l_returnflag, min(l_shipdate) AS x0, min(l_quantity) AS y0, max(l_shipdate) AS x1, max(l_quantity) AS y1 FROM lineitem GROUP BY 1")
def bounding_box(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_shipdate").alias("x0"), F.min("l_quantity").alias("y0"), F.max("l_shipdate").alias("x1"), F.max("l_quantity").alias("y1"))


@query("A30", "SELECT o_custkey, list_sort(list(o_totalprice))[1 + (count(*) // 10)] AS margin FROM orders GROUP BY o_custkey")
def tenth_value(spark, d):
    """The value at index n div 10 of each sorted group, found by rank so that no group is held as a list."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w.orderBy("o_totalprice")).alias("k"), F.count("*").over(w).alias("n"))
    return o.where("k = 1 + n div 10").select("o_custkey", F.col("o_totalprice").alias("margin"))


@query("A31 A32", "WITH s AS (SELECT c_nationkey, min(c_custkey) AS a, max(c_custkey) AS b FROM customer GROUP BY 1), e AS (SELECT c_nationkey, unnest(generate_series(a, b)) AS k FROM s) SELECT e.c_nationkey, count(*) AS missing FROM e ANTI JOIN customer c ON c.c_custkey = e.k AND c.c_nationkey = e.c_nationkey GROUP BY 1")
def numbering_gaps(spark, d):
    """Numbers missing between the first and the last of each nation: the distance of the ends less the numbers there are."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"), F.countDistinct("c_custkey").alias("n"))
    return c.select("c_nationkey", (F.col("b") - F.col("a") + 1 - F.col("n")).alias("missing")).where("missing > 0")


@query("A27", """WITH g AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN 'LARGE' END, CASE WHEN p_retailprice < 950 THEN 'CHEAP' END, CASE WHEN p_name LIKE '%a%' THEN 'NAME' END], lambda x: x IS NOT NULL)) AS gap FROM part)
SELECT gap, count(*) AS n, (SELECT round(100.0 * count(*) / (SELECT count(*) FROM part), 1) FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM g)) AS complete FROM g GROUP BY gap""")
def completeness(spark, d):
    gaps = F.array_compact(F.array(F.when(F.col("p_size") > 40, "LARGE"), F.when(F.col("p_retailprice") < 950, "CHEAP"), F.when(F.col("p_name").contains("a"), "NAME")))
    g = table(spark, d, "part").select(gaps.alias("gaps"))
    by = g.select(F.explode(F.concat(F.array(F.when(F.size("gaps") == 0, "none").otherwise("any")), "gaps")).alias("gap")).groupBy("gap").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # five rows
    kind = lambda name: F.coalesce(F.sum(F.when(F.col("gap") == name, F.col("n"))).over(every), F.lit(0))
    share = F.round(kind("none") * 100.0 / (kind("none") + kind("any")), 1)
    return by.withColumn("complete", share).where("gap NOT IN ('none', 'any')")


@query("A34", """SELECT 'size' AS check, max(CASE WHEN p_brand = 'Brand#11' THEN s END) AS b11, max(CASE WHEN p_brand = 'Brand#22' THEN s END) AS b22 FROM (SELECT p_brand, CASE WHEN max(p_size) <= 50 THEN 'PASS' ELSE 'FAIL' END AS s FROM part GROUP BY 1)
UNION ALL SELECT 'price', max(CASE WHEN p_brand = 'Brand#11' THEN s END), max(CASE WHEN p_brand = 'Brand#22' THEN s END) FROM (SELECT p_brand, CASE WHEN min(p_retailprice) > 950 THEN 'PASS' ELSE 'FAIL' END AS s FROM part GROUP BY 1)""")
def checklist_matrix(spark, d):
    p = table(spark, d, "part").where("p_brand IN ('Brand#11', 'Brand#22')").groupBy("p_brand").agg(F.when(F.max("p_size") <= 50, "PASS").otherwise("FAIL").alias("size"), F.when(F.min("p_retailprice") > 950, "PASS").otherwise("FAIL").alias("price"))
    long = p.unpivot("p_brand", ["size", "price"], "check", "status")
    wide = long.groupBy("check").pivot("p_brand", ["Brand#11", "Brand#22"]).agg(F.max("status"))
    return wide.select("check", F.col("`Brand#11`").alias("b11"), F.col("`Brand#22`").alias("b22"))


@query("A36 K2", "SELECT r_name, n_name, count(c_custkey) AS n, dense_rank() OVER (ORDER BY n_name) - 1 AS code FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def nested_tree(spark, d):
    """A tree of regions, nations and customer counts, built nested and flattened for comparison."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    leaf = n.join(c, "n_nationkey", "left").select("n_regionkey", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    codes = n.select("n_name").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("n_name")) - 1)
    tree = leaf.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n"))).alias("nations")).join(r, F.col("n_regionkey") == r.r_regionkey)
    return tree.select("r_name", F.inline("nations")).join(codes, "n_name").select("r_name", "n_name", "n", F.col("code").cast("long").alias("code"))


@query("F1 F4 F5 F6 F7", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size IN (1, 5, 10, 15, 20, 25) AND contains(lower(p_name || ' ' || p_type), 'e') AND contains(lower(p_name || ' ' || p_type), 'a') ORDER BY p_partkey LIMIT 60")
def keyword_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    every = F.forall(F.array(F.lit("e"), F.lit("a")), lambda t: hay.contains(t))
    return table(spark, d, "part").where(F.col("p_brand").startswith("Brand#1") & F.col("p_size").isin(1, 5, 10, 15, 20, 25) & every).orderBy("p_partkey").limit(60).select("p_partkey", "p_name")


@query("F8 F20", "WITH f(event_type, family) AS (VALUES ('click', 'active'), ('purchase', 'active'), ('error', 'fault')) SELECT coalesce(family, 'structural') AS family, count(*) AS n FROM events LEFT JOIN f USING (event_type) GROUP BY 1")
def predicate_family(spark, d):
    f = spark.createDataFrame([("click", "active"), ("purchase", "active"), ("error", "fault")], "event_type string, family string")
    return table(spark, d, "events").join(F.broadcast(f), "event_type", "left").groupBy(F.coalesce("family", F.lit("structural")).alias("family")).agg(F.count("*").alias("n"))


@query("F9 F10 F14", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'CURRENT' WHEN l_linenumber < 3 THEN 'PAST' ELSE 'FUTURE' END AS tier, CASE WHEN l_discount IS NULL THEN 'DEFECT' WHEN l_discount < 0.02 THEN 'BELOW' WHEN l_discount > 0.08 THEN 'ABOVE' ELSE 'PASS' END AS verdict FROM lineitem")
def tolerance(spark, d):
    n, x = F.col("l_linenumber"), F.col("l_discount")
    tier = F.when(n == 3, "CURRENT").when(n < 3, "PAST").otherwise("FUTURE")
    verdict = F.when(x.isNull() | F.isnan(x), "DEFECT").when(x < 0.02, "BELOW").when(x > 0.08, "ABOVE").otherwise("PASS")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tier.alias("tier"), verdict.alias("verdict"))


@query("R18 K7", "SELECT p_partkey, greatest(1, p_size % 4) AS sets, (p_size * greatest(1, p_size % 4) + CASE WHEN p_brand = 'Brand#11' THEN ceil(p_size * greatest(1, p_size % 4) * 0.1) ELSE 0 END)::BIGINT AS needed FROM part")
def bill_of_materials(spark, d):
    sets = F.greatest(F.lit(1), F.col("p_size") % 4)
    base = F.col("p_size") * sets
    return table(spark, d, "part").select("p_partkey", sets.alias("sets"), (base + F.when(F.col("p_brand") == "Brand#11", F.ceil(base * 0.1)).otherwise(0)).cast("long").alias("needed"))


@query("U1", "SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, p_size FROM part")
def union_of_kinds(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True)


@query("U2 K3 K4 K5", "SELECT event_type, user_id, ts FROM (SELECT event_type, user_id, ts FROM events WHERE user_id % 3 <> 0 UNION SELECT event_type, user_id, ts FROM events WHERE user_id % 2 = 0) WHERE event_type <> 'view'")
def merge_distinct(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "ts")
    return e.where("user_id % 3 <> 0").unionByName(e.where("user_id % 2 = 0")).dropDuplicates().where("event_type <> 'view'")


@query("U4 U5 U6", "WITH a AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS x, list(DISTINCT l_linestatus) AS y, list(DISTINCT CASE WHEN l_tax > 0.07 THEN l_returnflag END) FILTER (l_tax > 0.07) AS z FROM lineitem GROUP BY 1) SELECT l_suppkey, len(list_intersect(x, ['A', 'N']))::INTEGER AS common, len(list_intersect(coalesce(z, []), x)) = len(coalesce(z, [])) AS subset, len(list_intersect(x, coalesce(z, []))) = len(x) AS equal FROM a")
def set_predicates(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("x"), F.collect_set(F.when(F.col("l_tax") > 0.07, F.col("l_returnflag"))).alias("z"))
    lit = F.array(F.lit("A"), F.lit("N"))
    return a.select("l_suppkey", F.size(F.array_intersect("x", lit)).alias("common"), (F.size(F.array_except("z", "x")) == 0).alias("subset"), ((F.size(F.array_except("x", "z")) == 0) & (F.size(F.array_except("z", "x")) == 0)).alias("equal"))


@query("U7 F9 G13", "WITH a AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) SELECT l_partkey, CASE WHEN a.q IS NULL THEN 'ADDED' WHEN b.q IS NULL THEN 'REMOVED' WHEN a.q <> b.q THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM a FULL JOIN b USING (l_partkey)")
def revision_diff(spark, d):
    line = table(spark, d, "lineitem")
    a = line.where("l_linenumber <= 2").groupBy("l_partkey").agg(F.max("l_quantity").alias("old"))
    b = line.where("l_linenumber > 2").groupBy("l_partkey").agg(F.max("l_quantity").alias("new"))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "MODIFIED").otherwise("UNCHANGED")
    return a.join(b, "l_partkey", "full").select("l_partkey", change.alias("change"))
