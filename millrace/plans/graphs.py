"""Queries over graphs in the star tables: parts that follow each other in orders, and regions down to customers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import forest, graph, joins
from millrace.operators.stored import stored
from millrace.registry import query, table

_FOLLOWS = "SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem"
_EDGES = f"e AS (SELECT DISTINCT src, dst FROM ({_FOLLOWS}) WHERE dst IS NOT NULL AND src <> dst)"


def _edges(spark, d):
    """(src, dst): each part with the part on the next line of any order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("src <> dst").distinct()


@query("G1 G5 G6 G15", f"WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query("G2 G10 G11", f"""WITH RECURSIVE {_EDGES}, walk(start, node, level) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src % 100 = 0 UNION SELECT w.start, e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.level < 2)
SELECT start, node, min(level) AS level FROM walk GROUP BY start, node""")
def trace_levels(spark, d):
    """Two steps from every part that is asked for: those whose key is divisible by 100."""
    e = _edges(spark, d)
    return graph.reached(e.where("src % 100 = 0").select(F.col("src").alias("start")).distinct(), e, 2).select("start", "node", "level")


_WALK = f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), walk(start, node, level) AS (SELECT 1::BIGINT, 1::BIGINT, 0 UNION SELECT w.start, u.dst, w.level + 1 FROM walk w JOIN u ON u.src = w.node WHERE w.level < 6),
near AS (SELECT start, node, min(level) AS level FROM walk GROUP BY start, node)"""


@query("G3 G4", f"{_WALK} SELECT node, level AS hops FROM near")
def shortest_path_length(spark, d):
    start = spark.createDataFrame([(1,)], "start long")
    return graph.reached(start, graph.undirected(_edges(spark, d)), 6).select("node", F.col("level").alias("hops"))


@query("G3", f"{_WALK} SELECT a.start, a.node, a.level, (SELECT min(u.src) FROM u JOIN near b ON b.node = u.src WHERE u.dst = a.node AND b.level = a.level - 1) AS parent FROM near a")
def shortest_path_parents(spark, d):
    """Going from parent to parent gives a shortest path, the one of the smallest nodes."""
    start = spark.createDataFrame([(1,)], "start long")
    return graph.reached(start, graph.undirected(_edges(spark, d)), 6)


@query("G7 G8 G9 G20", """WITH RECURSIVE f(node, parent) AS (SELECT 'R' || r_regionkey, NULL FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
t(node, root, level, path) AS (SELECT node, node, 0, node FROM f WHERE parent IS NULL UNION ALL SELECT f.node, t.root, t.level + 1, t.path || '/' || f.node FROM f JOIN t ON f.parent = t.node) SELECT node, root, level, path FROM t""")
def hierarchy_paths(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    return graph.hierarchy(r.unionByName(n).unionByName(c))


@query("G12", f"WITH RECURSIVE {_EDGES}, walk(origin, place) AS (SELECT src, dst FROM e UNION SELECT w.origin, e.dst FROM walk w JOIN e ON e.src = w.place) SELECT DISTINCT origin AS node FROM walk WHERE origin = place")
def cycle_nodes(spark, d):
    return graph.cycles(_edges(spark, d))


@query("J23 G14", f"WITH {_EDGES}, o AS (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT a, b FROM o WHERE a < b) SELECT p.a, p.b, CASE WHEN x.src IS NOT NULL OR y.src IS NOT NULL THEN 'FOLLOWS' END AS rel, CASE WHEN x.src IS NOT NULL THEN FALSE WHEN y.src IS NOT NULL THEN TRUE END AS reversed FROM p LEFT JOIN e x ON x.src = p.a AND x.dst = p.b LEFT JOIN e y ON y.src = p.b AND y.dst = p.a")
def explained_pairs(spark, d):
    """How the first and the last part of each order relate."""
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    return joins.either_direction(p.where("a < b").select("a", "b").distinct(), _edges(spark, d).withColumn("rel", F.lit("FOLLOWS")))


@query("G18", f"""WITH {_EDGES}, f AS (SELECT src AS node, dst AS feature FROM e), s AS (SELECT node, count(*) AS n FROM f GROUP BY 1), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
c AS (SELECT x.node AS a, y.node AS b, count(*) AS common FROM f x JOIN f y USING (feature) WHERE x.node <> y.node AND x.node % 100 = 0 GROUP BY ALL),
z AS (SELECT a, b, round(least(1.0::DOUBLE, common / (p.n + q.n - common) + CASE WHEN u.src IS NULL THEN 0.0 ELSE 0.3 END)::DOUBLE, 6) AS score FROM c JOIN s p ON p.node = a JOIN s q ON q.node = b LEFT JOIN u ON u.src = a AND u.dst = b)
SELECT a, b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM z WHERE score > 0.05) WHERE rank <= 5""")
def node_neighbours(spark, d):
    """Neighbours, among all parts, of those whose key is divisible by 100."""
    e = _edges(spark, d)
    asked = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node"))
    return graph.similar_nodes(e.select(F.col("src").alias("node"), F.col("dst").alias("feature")), e, 5, asked)


@query("G16 G21 S12", """WITH n AS (SELECT c_custkey % 1000 AS id, min(c_custkey) AS seq FROM customer GROUP BY 1), e AS (SELECT o_custkey % 1200 AS src, o_orderkey % 1100 AS dst, o_orderstatus AS rel, min(o_orderkey) AS seq FROM orders GROUP BY ALL)
SELECT src, dst, rel, seq FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_upsert(spark, d):
    n = table(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("id"), F.col("c_custkey").alias("seq"))
    e = table(spark, d, "orders").select((F.col("o_custkey") % 1200).alias("src"), (F.col("o_orderkey") % 1100).alias("dst"), F.col("o_orderstatus").alias("rel"), F.col("o_orderkey").alias("seq"))
    return graph.upsert(n, e)[1].select("src", "dst", "rel", "seq")


@query("G17", "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 200000 THEN 'own-' || o_orderkey END, 'to-' || a.k, 'from-' || b.k) AS evidence FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey, min(c_nationkey) AS k FROM customer WHERE c_acctbal > 0 GROUP BY 1) b ON b.c_custkey = o_custkey")
def edge_evidence(spark, d):
    o = table(spark, d, "orders")
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("ka"))
    b = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.min("c_nationkey").alias("kb"))
    own = F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("own-"), "o_orderkey"))
    return o.join(a, "o_orderkey", "left").join(b, "o_custkey", "left").select("o_orderkey", F.coalesce(own, F.concat(F.lit("to-"), "ka"), F.concat(F.lit("from-"), "kb")).alias("evidence"))


@query("K6", "SELECT 'MERGE (n:Nation {id: ' || n_nationkey || ', name: ''' || n_name || '''})' AS line FROM nation UNION ALL SELECT 'MATCH (a:Nation {id: ' || n_nationkey || '}), (b:Region {id: ' || n_regionkey || '}) MERGE (a)-[:IN]->(b)' FROM nation")
def cypher_lines(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.format_string("MERGE (n:Nation {id: %d, name: '%s'})", "n_nationkey", "n_name").alias("line"))
    return nodes.union(n.select(F.format_string("MATCH (a:Nation {id: %d}), (b:Region {id: %d}) MERGE (a)-[:IN]->(b)", "n_nationkey", "n_regionkey")))


_FOREST = """f(node, parent) AS (SELECT 'R' || r_regionkey, NULL FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders),
t(node, parent, root, level, path) AS (SELECT node, parent, node, 0, [node] FROM f WHERE parent IS NULL UNION ALL SELECT f.node, f.parent, t.root, t.level + 1, list_append(t.path, f.node) FROM f JOIN t ON f.parent = t.node)"""


def _forest(spark, d):
    """Regions, their nations, customers and orders."""
    named = lambda t, kind, key, above, parent: table(spark, d, t).select(F.concat(F.lit(kind), key).alias("node"), F.concat(F.lit(above), parent).alias("parent"))
    roots = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    rows = roots.unionByName(named("nation", "N", "n_nationkey", "R", "n_regionkey")).unionByName(named("customer", "C", "c_custkey", "N", "c_nationkey"))
    return forest.labelled(rows.unionByName(named("orders", "O", "o_orderkey", "C", "o_custkey")))


@query("G7 G8 G20", f"""WITH RECURSIVE {_FOREST}, n AS (SELECT anc, count(*) AS size FROM (SELECT unnest(path) AS anc FROM t) GROUP BY anc), k AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS enter FROM t)
SELECT node, parent, root, level, enter, enter + size - 1 AS leave FROM k JOIN n ON anc = node""")
def forest_intervals(spark, d):
    return _forest(spark, d)


_CLOSED = "node LIKE 'N%' AND substr(node, 2)::INTEGER % 3 = 0 OR node = 'R1' OR node LIKE 'C%' AND substr(node, 2)::INTEGER % 7 = 0"


@query("G8 G9", f"WITH RECURSIVE {_FOREST}, c AS (SELECT list(node) AS closed FROM f WHERE {_CLOSED}) SELECT node, level, len(list_intersect(list_slice(path, 1, -2), closed)) = 0 AS visible FROM t, c")
def visible_nodes(spark, d):
    """What a tree shows when some nations, customers and a region are collapsed."""
    rows = stored(_forest(spark, d), "forest")
    key = F.substring("node", 2, 20).cast("long")
    closed = (F.col("node").startswith("N") & (key % 3 == 0)) | (F.col("node") == "R1") | (F.col("node").startswith("C") & (key % 7 == 0))
    return forest.visible(rows, rows.where(closed)).select("node", "level", "visible")


@query("G9 G20", f"WITH RECURSIVE {_FOREST}, p AS (SELECT node, level, unnest(path) AS top, generate_subscripts(path, 1) - 1 AS k FROM t) SELECT top, node, (level - k)::INTEGER AS below FROM p WHERE (top LIKE 'R%' OR top LIKE 'C%' AND substr(top, 2)::INTEGER % 100 = 0) AND level - k <= 2")
def expanded_subtrees(spark, d):
    """Two levels under each region, and under customers whose key 100 divides."""
    rows = stored(_forest(spark, d), "forest")
    asked = rows.where(F.col("node").startswith("R") | (F.col("node").startswith("C") & (F.substring("node", 2, 20).cast("long") % 100 == 0)))
    return forest.subtrees(rows, asked, 2)
