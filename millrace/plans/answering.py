"""Queries of answers, dialogue, references and tables as text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import answers, search
from millrace.plans.graphs import _EDGES, _edges
from millrace.plans.retrieval import INDEX_SQL, best_documents, gold
from millrace.registry import query, table
from millrace.streaming import talk


@query("R4", f"""WITH {INDEX_SQL}, named AS (SELECT item_id, item_id * 3 AS doc_id, item_id % 2 = 0 AS exact FROM benchmark),
b AS (SELECT item_id, doc_id, coalesce(score, 0) AS score, exact FROM ranked FULL JOIN named USING (item_id, doc_id)),
o AS (SELECT *, max(CASE WHEN exact IS NULL THEN score END) OVER (PARTITION BY item_id) AS other FROM b)
SELECT item_id, doc_id, round(CASE WHEN exact THEN greatest(score, coalesce(other, 0)) + 5 WHEN NOT exact THEN score + 6 ELSE score END, 6) AS score FROM o""")
def identifier_promotion(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    scored = search.score(items, search.index_for(items, docs)).select("item_id", "doc_id", "score")
    named = items.select("item_id", (F.col("item_id") * 3).alias("doc_id"), (F.col("item_id") % 2 == 0).alias("exact"))
    return answers.promoted(scored, named).select("item_id", "doc_id", "score")


@query("R10", f"""WITH {INDEX_SQL}, c AS (SELECT item_id, doc_id, score, CASE WHEN n_chars > 500 AND lang = 'en' THEN 0 WHEN n_chars > 200 THEN 1 ELSE 2 END AS rule FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, rule FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rule, score DESC, doc_id) = 1""")
def preferred_answer(spark, d):
    docs = table(spark, d, "documents")
    top = best_documents(spark, d, 10)[-1].join(docs.select("doc_id", "n_chars", "lang"), "doc_id")
    rules = [(F.col("n_chars") > 500) & (F.col("lang") == "en"), F.col("n_chars") > 200]
    return answers.preferred(top, rules, [F.desc("score"), F.col("doc_id")], ["item_id"]).select("item_id", "doc_id", "rule")


@query("R11 W22", r"""WITH RECURSIVE u AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE role = 'user'),
m AS (SELECT *, regexp_matches(said, '(?i)^(and|what about|it|that|this)\b') OR len(regexp_extract_all(said, '\S+')) < 3 AS follows FROM u),
w(conv_id, i, turn, focus, query, joined) AS (SELECT DISTINCT conv_id, 0::BIGINT, NULL::BIGINT, '', '', false FROM u UNION ALL
  SELECT m.conv_id, m.i, m.turn, CASE WHEN follows AND focus <> '' THEN focus ELSE said END, CASE WHEN follows AND focus <> '' THEN focus || ' ' || said ELSE said END, follows AND focus <> '' FROM w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1)
SELECT conv_id, turn, query, joined FROM w WHERE i > 0""")
def dialogue_queries(spark, d):
    return answers.dialogue(table(spark, d, "conversations"))


@query("R12", f"""WITH {_EDGES}, a AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT -1)
SELECT node, 'out' AS relation, dst AS other FROM a JOIN e ON src = node UNION ALL SELECT node, 'in', src FROM a JOIN e ON dst = node UNION ALL SELECT node, 'none', NULL FROM a WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e)""")
def relation_replies(spark, d):
    """What stands on either side of each asked part, or that nothing does (-1 is no part)."""
    e = _edges(spark, d)
    a = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node")).union(spark.range(-1, 0))
    out = a.join(e, a.node == e.src).select("node", F.lit("out").alias("relation"), F.col("dst").alias("other"))
    into = a.join(e, a.node == e.dst).select("node", F.lit("in").alias("relation"), F.col("src").alias("other"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    none = a.join(ends, "node", "left_anti").select("node", F.lit("none").alias("relation"), F.lit(None).cast("long").alias("other"))
    return out.unionByName(into).unionByName(none)


@query("X33")
def located_items(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    pairs = gold(items, docs).join(items.select("item_id", F.col("text").alias("item")), "item_id").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    return answers.located(pairs)


@query("W18 X21", """WITH RECURSIVE r AS (SELECT l_orderkey, l_quantity::DOUBLE AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i FROM lineitem),
w(l_orderkey, i, v, anchor, cluster) AS (SELECT l_orderkey, i, v, v, 1 FROM r WHERE i = 1 UNION ALL
  SELECT r.l_orderkey, r.i, r.v, CASE WHEN r.v - anchor > 3 THEN r.v ELSE anchor END, cluster + CASE WHEN r.v - anchor > 3 THEN 1 ELSE 0 END FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.i = w.i + 1)
SELECT l_orderkey, v AS l_quantity, cluster FROM w""")
def row_clusters(spark, d):
    return answers.clusters(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 3.0)


@query("W16", """WITH t AS (SELECT p_partkey, 'from ' || p_size || ' to ' || (p_size + 5) || ' mm and ' || (p_size * 2) || ' mm when wet, at ' || p_partkey || ' kg' AS t FROM part),
r AS (SELECT p_partkey, 'range' AS kind, unnest(regexp_extract_all(t, '[0-9]+ to [0-9]+ [a-z]+')) AS raw FROM t), s AS (SELECT p_partkey, 'single' AS kind, unnest(regexp_extract_all(regexp_replace(t, '[0-9]+ to [0-9]+ [a-z]+', '#', 'g'), '[0-9]+ [a-z]+')) AS raw FROM t)
SELECT p_partkey, kind, raw, contains(t, raw || ' when wet') AS conditional FROM (SELECT * FROM r UNION ALL SELECT * FROM s) JOIN t USING (p_partkey)""")
def prioritized_values(spark, d):
    """Ranges are taken first; single values only from what they leave."""
    n = F.col("p_size")
    t = F.concat(F.lit("from "), n, F.lit(" to "), n + 5, F.lit(" mm and "), n * 2, F.lit(" mm when wet, at "), "p_partkey", F.lit(" kg"))
    p = table(spark, d, "part").select("p_partkey", t.alias("t"))
    pattern = "[0-9]+ to [0-9]+ [a-z]+"
    both = F.concat(
        F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), lambda r: F.struct(F.lit("range").alias("kind"), r.alias("raw"))),
        F.transform(F.regexp_extract_all(F.regexp_replace("t", pattern, "#"), F.lit("[0-9]+ [a-z]+"), F.lit(0)), lambda r: F.struct(F.lit("single").alias("kind"), r.alias("raw"))),
    )
    return p.select("p_partkey", "t", F.inline(both)).select("p_partkey", "kind", "raw", F.col("t").contains(F.concat("raw", F.lit(" when wet"))).alias("conditional"))


@query("X6 X7", "SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 60), '\\s+\\S*\\z', '') || '…' END AS quote FROM benchmark")
def cut_quotes(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.when(F.length(t) <= 60, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 60), r"\s+\S*\z", ""), F.lit("…"))).alias("quote"))


@query("J9 J8", "WITH s AS (SELECT o_orderkey, 'ordered for ' || o_totalprice::BIGINT || ' in ' || year(o_orderdate) || '. Status ' || o_orderstatus || '.' AS t, o_totalprice::BIGINT::VARCHAR AS raw FROM orders) SELECT o_orderkey, strpos(t, raw) - 1 AS start, CASE WHEN strpos(t, raw) <= strpos(t, '.') THEN 0 ELSE 1 END AS sentence FROM s")
def span_in_sentence(spark, d):
    price = F.round("o_totalprice").cast("long").cast("string")
    t = F.concat(F.lit("ordered for "), price, F.lit(" in "), F.year("o_orderdate"), F.lit(". Status "), "o_orderstatus", F.lit("."))
    at = F.instr(t, price)
    return table(spark, d, "orders").select("o_orderkey", (at - 1).cast("long").alias("start"), F.when(at <= F.instr(t, "."), 0).otherwise(1).alias("sentence"))


@query("F17 F23 X38 A37", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'drawing No. ' ELSE 'about ' END || (p_partkey * 37 % 20000) || CASE p_partkey % 3 WHEN 0 THEN ' of the annex' WHEN 1 THEN ' as per ISO 9' ELSE '' END AS t FROM part),
n AS (SELECT p_partkey, t, regexp_extract(t, '([0-9]+)', 1)::INTEGER AS n FROM t), k AS (SELECT CASE WHEN n NOT BETWEEN 1000 AND 19999 THEN 'out of range' WHEN contains(t, 'No.') THEN 'strong' WHEN n BETWEEN 1900 AND 2100 THEN 'year' ELSE 'weak' END AS kind, CASE WHEN contains(t, ' of the ') THEN 'own' WHEN contains(t, ' as per ') THEN 'EXTERNAL' ELSE 'none' END AS scope FROM n)
SELECT kind, scope, count(*) AS n FROM k GROUP BY ALL""")
def cited_numbers(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, " of the annex").when(k % 3 == 1, " as per ISO 9").otherwise("")
    t = F.concat(F.when(k % 2 == 0, "drawing No. ").otherwise("about "), k * 37 % 20000, tail)
    x = table(spark, d, "part").select(t.alias("t")).withColumn("n", F.regexp_extract("t", "([0-9]+)", 1).cast("int"))
    kind = F.when(~F.col("n").between(1000, 19999), "out of range").when(F.col("t").contains("No."), "strong").when(F.col("n").between(1900, 2100), "year").otherwise("weak")
    scope = F.when(F.col("t").contains(" of the "), "own").when(F.col("t").contains(" as per "), "EXTERNAL").otherwise("none")
    return x.groupBy(kind.alias("kind"), scope.alias("scope")).agg(F.count("*").alias("n"))


@query("X29 X30 W9", """WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, min(CASE WHEN l_linenumber > 2 AND l_quantity > 20 THEN l_quantity::INTEGER::VARCHAR END) AS cell, min(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END) AS label FROM lineitem GROUP BY ALL),
h AS (SELECT t, coalesce(min(r) FILTER (cell IS NOT NULL) - 1, count(*)) AS header_rows FROM c GROUP BY t), f AS (SELECT t, r, cell, last_value(label IGNORE NULLS) OVER (PARTITION BY t ORDER BY r ROWS UNBOUNDED PRECEDING) AS label FROM c)
SELECT t, r, header_rows::BIGINT AS header_rows, label, cell FROM f JOIN h USING (t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY cell IS NULL, r) <= 4""")
def table_view(spark, d):
    line = table(spark, d, "lineitem")
    cell = F.when((F.col("l_linenumber") > 2) & (F.col("l_quantity") > 20), F.col("l_quantity").cast("int").cast("string"))
    c = line.groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r")).agg(F.min(cell).alias("cell"), F.min(F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag"))).alias("label"))
    h = c.groupBy("t").agg(F.coalesce(F.min(F.when(F.col("cell").isNotNull(), F.col("r"))) - 1, F.count("*")).cast("long").alias("header_rows"))
    w = Window.partitionBy("t").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    f = c.withColumn("label", F.last("label", ignorenulls=True).over(w)).join(h, "t")
    k = F.row_number().over(Window.partitionBy("t").orderBy(F.col("cell").isNull(), "r"))
    return f.withColumn("k", k).where("k <= 4").select("t", "r", "header_rows", "label", "cell")


@query("G19", "WITH x AS (SELECT c_custkey AS node, c_nationkey % 5 AS tier, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS place FROM customer) SELECT node, tier, (place - 1) % 10 * 40 AS x, tier * 100 AS y FROM x")
def tiers(spark, d):
    """A layered layout: nodes of one tier on one line, ten to a row."""
    tier = F.col("c_nationkey") % 5
    place = F.row_number().over(Window.partitionBy(tier).orderBy("c_custkey"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node"), tier.alias("tier"), ((place - 1) % 10 * 40).cast("long").alias("x"), (tier * 100).alias("y"))


@query("K8 S11", "SELECT p_partkey, printf('%-6s %5d %10.2f', p_brand, p_size, p_retailprice) AS line FROM part")
def report_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", F.format_string("%-6s %5d %10.2f", "p_brand", "p_size", "p_retailprice").alias("line"))


_SAID = "CASE (conv_id + turn) % 9 WHEN 0 THEN 'more' WHEN 2 THEN 'Source please' WHEN 4 THEN 'reset' WHEN 6 THEN concat('and ', text) WHEN 8 THEN concat('What of src', conv_id % 20, ' ', text) WHEN 7 THEN 'why so' ELSE text END"


def _starts(kind: str) -> str:
    return f"regexp_matches(said, '(?i)^(?:{talk.COMMANDS[kind]})\\b')"


@query("R11 W22 R27", f"""WITH RECURSIVE u AS (SELECT conv_id, turn, trim({_SAID}) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
m AS (SELECT *, CASE WHEN {_starts("reset")} THEN 'reset' WHEN {_starts("more")} THEN 'more' WHEN {_starts("source")} THEN 'source' WHEN {_starts("related")} THEN 'related' ELSE '' END AS command,
  regexp_extract(said, '{talk.SCOPE}', 1) AS named, regexp_matches(said, '(?i)^(?:{talk.FOLLOWS})\\b') OR len(regexp_extract_all(said, '\\S+')) < {talk.LEAST_WORDS} AS follows FROM u),
w(conv_id, i, turn, focus, in_scope, answered, kind, query, scope) AS (SELECT DISTINCT conv_id, 0::BIGINT, NULL::BIGINT, '', '', false, '', '', '' FROM u
  UNION ALL SELECT m.conv_id, m.i, m.turn,
    CASE WHEN command = 'reset' THEN '' WHEN command <> '' OR follows AND focus <> '' THEN focus ELSE said END,
    CASE WHEN command = 'reset' THEN '' WHEN command <> '' THEN in_scope WHEN follows AND focus <> '' AND named = '' THEN in_scope ELSE named END,
    CASE WHEN command = 'reset' THEN false WHEN command <> '' THEN answered ELSE true END,
    CASE WHEN command = 'reset' THEN command WHEN command <> '' THEN CASE WHEN answered THEN command ELSE 'no_context' END WHEN follows AND focus <> '' THEN 'follow_up' ELSE 'answer' END,
    CASE WHEN command = 'reset' THEN '' WHEN command <> '' THEN CASE WHEN answered THEN focus ELSE '' END WHEN follows AND focus <> '' THEN focus || ' ' || said ELSE said END,
    CASE WHEN command = 'reset' THEN '' WHEN command <> '' THEN CASE WHEN answered THEN in_scope ELSE '' END WHEN follows AND focus <> '' AND named = '' THEN in_scope ELSE named END
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1)
SELECT conv_id, turn, kind, query, scope FROM w WHERE i > 0""")
def talk_replies(spark, d):
    """What each user turn asks for: commands, resets, follow-ups that inherit topic and scope, and fresh questions."""
    return talk.replies(table(spark, d, "conversations").withColumn("text", F.expr(_SAID)))
