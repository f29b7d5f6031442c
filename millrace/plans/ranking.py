"""Ranking over the positional index: stems, titles, synonyms, pairs of words, scopes, coverage. A document's title is its first
sentence; a benchmark item with an even number asks for one source."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.functions.stem import STEP2, STEP3, STEP4
from millrace.functions.text import SEARCH_UNITS, STOP_WORDS, search_terms
from millrace.operators import blocks
from millrace.registry import query, table

#: Words that stand in for others: a run of terms, and the terms it adds at SYNONYM of their weight.
RULES = ((("der",), ("die", "das")), (("los",), ("las",)), (("de", "la"), ("del",)), (("ti",), ("tion",)), (("les",), ("des",)))
#: Added before rounding: products of few digits often end in a 5, which two engines may round apart.
TIE = 1e-9
SYNONYM, PAIR, OUT_OF_SCOPE, DEFAULT_SOURCE = 0.35, 0.5, 0.55, 1.15
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def porter_sql(words: str, least: int = 4) -> str:
    """CTEs that stem the column t of words, of at least so many letters: the result is stemmed(t, s). Y marks a y that is a
    consonant."""
    m0, m1, vowel, cvc = "[aeiouy][^aeiouy]", "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]", "[aeiouy]", "[^aeiouy][aeiouy][^aeiouywxY]$"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"
    cut = lambda n: f"left(s, length(s) - {n})"
    double = f"length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND NOT {has('right(s, 1)', vowel)}"

    def by(table):
        rows = sorted(table.items(), key=lambda x: -len(x[0]))
        return "CASE " + " ".join(f"WHEN suffix(s, '{a}') THEN CASE WHEN {has(cut(len(a)), m0)} THEN {cut(len(a))} || '{b}' ELSE s END" for a, b in rows) + " ELSE s END"

    last = " ".join(f"WHEN suffix(s, '{a}') THEN CASE WHEN {has(cut(len(a)), m1)}" + (f" AND {has(cut(3), '[st]$')}" if a == "ion" else "") + f" THEN {cut(len(a))} ELSE s END" for a in sorted(STEP4, key=len, reverse=True))
    steps = [
        "CASE WHEN suffix(s, 'sses') OR suffix(s, 'ies') THEN left(s, length(s) - 2) WHEN suffix(s, 's') AND NOT suffix(s, 'ss') THEN left(s, length(s) - 1) ELSE s END",
        f"CASE WHEN suffix(s, 'eed') THEN CASE WHEN {has(cut(3), m0)} THEN {cut(1)} ELSE s END WHEN suffix(s, 'ed') AND {has(cut(2), vowel)} THEN {cut(2)} || '+' WHEN suffix(s, 'ing') AND {has(cut(3), vowel)} THEN {cut(3)} || '+' ELSE s END",
        "rtrim(s, '+') AS s, suffix(s, '+') AS open",
        f"CASE WHEN NOT open THEN s WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' WHEN {double} AND right(s, 1) NOT IN ('l', 's', 'z') THEN {cut(1)} WHEN {has('s', m0)} AND NOT {has('s', m1)} AND {has('s', cvc)} THEN s || 'e' ELSE s END",
        f"CASE WHEN regexp_matches(s, '[yY]$') AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE s END",
        by(STEP2), by(STEP3), f"CASE {last} ELSE s END",
        f"CASE WHEN suffix(s, 'e') AND ({has(cut(1), m1)} OR {has(cut(1), m0)} AND NOT {has(cut(1), cvc)}) THEN {cut(1)} ELSE s END",
        f"CASE WHEN {has('s', m1)} AND suffix(s, 'll') THEN {cut(1)} ELSE s END",
    ]
    ctes = [f"p0 AS (SELECT DISTINCT t, regexp_replace(regexp_replace(t, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS s FROM {words} WHERE length(t) >= {least} AND regexp_matches(t, '^[a-z]+$'))"]
    for i, step in enumerate(steps):
        ctes.append(f"p{i + 1} AS (SELECT t, {step if ' AS ' in step else step + ' AS s'} FROM p{i})")
    return ",\n".join([*ctes, f"stemmed AS (SELECT t, lower(s) AS s FROM p{len(steps)})"])


def _tokens_sql(text: str) -> str:
    t = f"replace(translate(lower(coalesce({text}, '')), '‐‑‒–—―−‘’', '-------'''''), '°', ' deg ')"
    t = rf"regexp_replace({t}, '\b1\s*(?:in|:)\s*([0-9]+(?:\.[0-9]+)?)', '1in\1', 'g')"
    t = rf"regexp_replace({t}, '\b([0-9]+(?:\.[0-9]+)?)\s*({SEARCH_UNITS})\b', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '\b(?:kmph|km/h|kmh)\b', 'kmph', 'g')"
    whole = rf"regexp_extract_all({t}, '[a-z0-9]+(?:[./][a-z0-9]+)*')"
    parts = rf"flatten(list_transform({whole}, lambda t: CASE WHEN regexp_matches(t, '[./]') AND NOT regexp_matches(t, '^[0-9]+(?:\.[0-9]+)+$') THEN list_prepend(t, regexp_split_to_array(t, '[./]')) ELSE [t] END))"
    return f"list_filter({parts}, lambda t: t NOT IN ({_STOP}))"


_TITLE = r"regexp_extract(coalesce(text, ''), '^[^.!?\n]*')"
_RULE_ROWS = ", ".join(f"(' {' '.join(a)} ', '{b}')" for a, bs in RULES for b in bs)
INDEX_SQL = rf"""
dt AS (SELECT doc_id, {_tokens_sql(_TITLE)} AS a, {_tokens_sql("text")} AS b FROM documents),
dw AS (SELECT doc_id, unnest(a || b) AS t, unnest(range(len(a) + len(b))) AS p, len(a) AS n_title, len(a) + len(b) AS length FROM dt),
iw AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM (SELECT item_id, {_tokens_sql("text")} AS w FROM benchmark)),
words AS (SELECT t FROM dw UNION SELECT t FROM iw),
{porter_sql("words")},
d AS (SELECT doc_id, p, coalesce(s, t) AS term, CASE WHEN p < n_title THEN 3 ELSE 1 END AS w, length FROM dw LEFT JOIN stemmed USING (t)),
q AS (SELECT item_id, p, coalesce(s, t) AS term FROM iw LEFT JOIN stemmed USING (t)),
idx AS (SELECT doc_id, term, sum(w)::DOUBLE AS tf, any_value(length)::DOUBLE AS length FROM d GROUP BY ALL),
stat AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM (SELECT doc_id, any_value(length) AS length FROM idx GROUP BY doc_id)),
df AS (SELECT term, count(*)::DOUBLE AS df FROM idx GROUP BY term),
rules(run, extra) AS (VALUES {_RULE_ROWS}),
said AS (SELECT item_id, ' ' || string_agg(term, ' ' ORDER BY p) || ' ' AS line FROM q GROUP BY item_id),
own AS (SELECT DISTINCT item_id, term, 1.0 AS weight FROM q),
extra AS (SELECT DISTINCT item_id, extra AS term, {SYNONYM} AS weight FROM said JOIN rules ON contains(line, run) WHERE NOT contains(line, ' ' || extra || ' ')),
asked AS (SELECT *, ln(1 + (n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5)) AS idf FROM (SELECT * FROM own UNION ALL SELECT * FROM extra) LEFT JOIN df USING (term), stat),
scored AS (SELECT item_id, doc_id, round(sum(idf * weight * tf * 2 / (tf + (1 - 0.75 + 0.75 * length / average))), 6) AS score FROM asked JOIN idx USING (term) GROUP BY item_id, doc_id),
cand AS (SELECT item_id, doc_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 200),
qp AS (SELECT item_id, a.term AS x, b.term AS y FROM q a JOIN q b USING (item_id) WHERE b.p = a.p + 1),
dp AS (SELECT DISTINCT doc_id, a.term AS x, b.term AS y FROM d a JOIN d b USING (doc_id) WHERE b.p = a.p + 1),
n_pairs AS (SELECT item_id, count(*) AS pairs FROM qp GROUP BY item_id),
hits AS (SELECT item_id, doc_id, count(*) AS n FROM cand JOIN qp USING (item_id) JOIN dp USING (doc_id, x, y) GROUP BY item_id, doc_id),
final AS (SELECT item_id, doc_id, source, coalesce(h.n, 0) AS bigrams, round(score * ((1 + {PAIR} * coalesce(h.n, 0) / coalesce(pairs, 1))
    * CASE WHEN item_id % 2 = 0 THEN CASE WHEN source = 'src' || item_id % 20 THEN 1.0 ELSE {OUT_OF_SCOPE} END WHEN source = 'src0' THEN {DEFAULT_SOURCE} ELSE 1.0 END
    * CASE WHEN n_chars < 200 THEN 0.6 ELSE 1.0 END * CASE WHEN contains(text, ' | ') THEN 0.9 ELSE 1.0 END) + {TIE}, 6) AS score
  FROM cand JOIN documents USING (doc_id) LEFT JOIN n_pairs USING (item_id) LEFT JOIN hits h USING (item_id, doc_id)),
lead AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lead)"""


def _index(spark, d):
    """The index of documents with titles, kept for the table as it is."""
    title = lambda docs: docs.withColumn("title", F.regexp_extract("text", r"^[^.!?\n]*", 0))
    return blocks.opened(blocks.kept(spark, f"{d}/documents.parquet", "titled", lambda docs: blocks.build(title(docs), title="title")))


def _stand_ins(items):
    """(item_id, term, weight) that RULES add."""
    line = F.concat(F.lit(" "), F.array_join(search_terms(F.col("text")), " "), F.lit(" "))
    added = [F.when(F.col("line").contains(f" {' '.join(run)} "), F.array(*map(F.lit, extra))).otherwise(F.array().cast("array<string>")) for run, extra in RULES]
    told = items.select("item_id", line.alias("line")).select("item_id", F.explode(F.array_distinct(F.flatten(F.array(*added)))).alias("term"))
    return told.withColumn("weight", F.lit(SYNONYM))


def _ranked(spark, d):
    """(index, weighed questions, candidates with factors, best of each source first)."""
    docs, items, index = table(spark, d, "documents"), table(spark, d, "benchmark"), _index(spark, d)
    told = blocks.weighed(items, index, extra=_stand_ins(items))
    seen = blocks.evidence(blocks.best(told, index, 200), told, index)
    about = docs.select(F.col("doc_id").alias("key"), "source", F.when(F.col("n_chars") < 200, 0.6).otherwise(1.0).alias("short"), F.when(F.contains("text", F.lit(" | ")), 0.9).otherwise(1.0).alias("table"))
    named = F.concat(F.lit("src"), F.col("question") % 20)
    scope = F.when(F.col("question") % 2 == 0, F.when(F.col("source") == named, 1.0).otherwise(OUT_OF_SCOPE)).when(F.col("source") == "src0", DEFAULT_SOURCE).otherwise(1.0)
    factor = (1 + PAIR * F.col("bigrams") / F.greatest("pairs", F.lit(1))) * scope * F.col("short") * F.col("table")
    final = seen.join(about, "key").withColumn("score", F.round(F.col("score") * factor + TIE, 6))
    best = Window.partitionBy("question", "source").orderBy(F.desc("score"), "key")
    lead = final.withColumn("k", F.row_number().over(best)).where("k = 1")
    return index, told, lead.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "key")))


@query("R1 R3 X1 X4 A7 J13 F2 W1", f"WITH {INDEX_SQL} SELECT item_id, doc_id, source, bigrams::INTEGER AS bigrams, score, rank::INTEGER AS rank FROM placed WHERE rank <= 10")
def ranked_passages(spark, d):
    """The ten best documents of each item, one of a source: BM25 over stems with titles, then pairs of words, scope and kind."""
    _, _, top = _ranked(spark, d)
    return top.where("rank <= 10").select(F.col("question").alias("item_id"), F.col("key").alias("doc_id"), "source", "bigrams", "score", "rank")


_COVER = "sum(CASE WHEN list_contains(have, term) OR {0} THEN idf ELSE 0 END) / sum(idf)"


@query("A9 R5 J14", f"""WITH {INDEX_SQL},
alt AS (SELECT trim(run) AS term, extra FROM rules WHERE NOT contains(trim(run), ' ')),
have AS (SELECT item_id, max(rank) AS top, list(DISTINCT term) AS have FROM (SELECT item_id, 1 AS rank, doc_id FROM placed WHERE rank = 1 UNION ALL SELECT item_id, 3, doc_id FROM placed WHERE rank <= 3) JOIN idx USING (doc_id) GROUP BY item_id, rank),
got AS (SELECT item_id, top, {_COVER.format("len(list_intersect(have, coalesce(alts, []))) > 0")} AS c, sum(CASE WHEN list_contains(have, term) OR len(list_intersect(have, coalesce(alts, []))) > 0 THEN idf ELSE 0 END) AS mass
  FROM have JOIN asked USING (item_id) LEFT JOIN (SELECT term, list(extra) AS alts FROM alt GROUP BY term) USING (term) WHERE weight = 1 GROUP BY item_id, top)
SELECT item_id, round(max(c) FILTER (top = 1), 6) AS coverage, round(max(c) FILTER (top = 3), 6) AS coverage3, round(max(mass) FILTER (top = 1), 6) AS mass,
  CASE WHEN max(c) FILTER (top = 1) >= 0.66 OR max(c) FILTER (top = 1) >= 0.4 AND max(mass) FILTER (top = 1) >= 18 THEN 'answer' ELSE 'no_evidence' END AS status FROM got GROUP BY item_id""")
def pooled_coverage(spark, d):
    """The share, by idf, of each item's terms in its best document and in its three best: a term counts, too, if the document has
    what stands in for it."""
    _, told, top = _ranked(spark, d)
    held = top.where("rank <= 3").groupBy("number").agg(F.flatten(F.collect_list("matched")).alias("three"), F.flatten(F.collect_list(F.when(F.col("rank") == 1, F.col("matched")))).alias("one"))
    words = told.select("number", "question", F.explode("weights").alias("w")).where("w.weight = 1").select("number", "question", "w.term", "w.idf")
    both = words.join(held, "number")

    def has(c: str) -> Column:
        found = F.array_contains(c, F.col("term"))
        for run, extra in RULES:
            if len(run) == 1:
                found |= (F.col("term") == run[0]) & F.arrays_overlap(c, F.array(*map(F.lit, extra)))
        return F.when(found, F.col("idf")).otherwise(0.0)

    got = both.groupBy("question").agg(F.sum("idf").alias("all"), F.sum(has("one")).alias("mass"), F.sum(has("three")).alias("mass3"))
    share = F.col("mass") / F.col("all")
    enough = (share >= 0.66) | ((share >= 0.4) & (F.col("mass") >= 18))
    return got.select(F.col("question").alias("item_id"), F.round(share, 6).alias("coverage"), F.round(F.col("mass3") / F.col("all"), 6).alias("coverage3"), F.round("mass", 6).alias("mass"), F.when(enough, "answer").otherwise("no_evidence").alias("status"))
