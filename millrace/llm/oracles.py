"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
k AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a),
reach(start, node) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.start, e.b FROM reach r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.node), d.doc_id)) AS component_id, coalesce(k.links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN reach r ON r.start = d.doc_id GROUP BY d.doc_id, n.n, k.links"""

OP2 = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest([array_to_string(w[j : j + least(10, len(w)) - 1], ' ') FOR j IN range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest([array_to_string(w[j : j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS g FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT g.doc_id, g.p, g.k, win.item_id FROM g JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest([sha256(array_to_string(w[j : j + 49], ' ')) FOR j IN range(1, len(w) - 48)]) AS g FROM d WHERE len(w) >= 50),
low AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
cut AS (SELECT doc_id, list(DISTINCT x) AS xs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS x FROM g JOIN low USING (g) WHERE low < doc_id) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
gone AS (SELECT doc_id, unnest(xs) AS p FROM cut),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(xs), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: crc32 of an ASCII text, by its table of 256 remainders (column t of crc).
_CRC = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda k: ascii({0}[k])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

OP13 = rf"""
WITH RECURSIVE {_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, {_CRC32.format("key")} % 20 AS f FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS (SELECT *, left(role, 1) AS kind, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
e AS (SELECT conv_id, i, role, text, kind, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated,
  i > 1 AND lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind NOT IN ('su', 'ua', 'au') AS illegal FROM r),
told AS (SELECT conv_id, count(*) AS n, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(illegal::INT) AS illegal FROM e GROUP BY conv_id),
gap AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM d GROUP BY conv_id),
moves(state, ins, pos, new) AS (VALUES (0, '', 0, ''), (0, 'I', 2, 'user:'), (0, 'II', 3, E'user:\nassistant:'), (1, '', 1, ''), (1, 'I', 2, 'user:'), (1, 'II', 3, E'user:\nassistant:'), (2, '', 2, ''), (2, 'I', 3, 'assistant:'), (3, '', 3, ''), (3, 'I', 2, 'user:')),
edits(edit, fee) AS (VALUES ('D', 3), ('R', 2), ('K', 0)),
ways(conv_id, i, state, way) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} FROM d
  UNION ALL
  SELECT conv_id, i, after, min(way) FROM (
    SELECT e.conv_id, e.i, CASE WHEN edit = 'D' THEN pos WHEN edit = 'K' AND kind = 's' THEN 1 WHEN pos = 2 THEN 3 ELSE 2 END AS after,
      {{'cost': way.cost + 2 * length(ins) + fee + CASE WHEN truncated AND edit <> 'D' THEN 1 ELSE 0 END, 'audit': way.audit || ins || edit,
        'out': array_to_string(list_filter([way.out, new, CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE WHEN pos = 2 THEN 'assistant:' ELSE 'user:' END || text ELSE '' END], lambda x: x <> ''), chr(10))}} AS way
    FROM ways JOIN e ON e.conv_id IS NOT DISTINCT FROM ways.conv_id AND e.i = ways.i + 1 JOIN moves USING (state), edits
    WHERE edit = 'D' OR NOT blank AND NOT duplicate AND (edit = 'R' OR kind = 's' AND pos = 0 OR kind = 'u' AND pos <> 2 OR kind = 'a' AND pos = 2)) GROUP BY conv_id, i, after),
done AS (SELECT ways.conv_id, min({{'cost': way.cost + 2 * length(ins), 'audit': way.audit || ins, 'out': array_to_string(list_filter([way.out, new], lambda x: x <> ''), chr(10))}}) AS way
  FROM ways JOIN told ON told.conv_id IS NOT DISTINCT FROM ways.conv_id AND told.n = ways.i JOIN moves USING (state) WHERE state IN (0, 3) AND ins = '' OR state IN (1, 2) AND pos = 3 GROUP BY ways.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(way.out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN gap ON gap.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"

OP11 = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf, CASE WHEN {_CRC32.format("(doc_id::VARCHAR)")} % 2 = 0 THEN {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))} END AS changed FROM documents, crc),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
node(tree, lev, i, n, h) AS (SELECT tree, 0, i, n, leaf FROM l UNION ALL SELECT tree, lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY tree, lev, i // 3, n),
top(lev, i, n, h) AS (SELECT 0, tree - 1, (SELECT count(DISTINCT tree) FROM l), h FROM node WHERE n = 1 UNION ALL SELECT lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lev, i // 3, n),
step AS (SELECT tree, lev, i, coalesce(string_agg(h, '' ORDER BY i) OVER before, '') || '|' || coalesce(string_agg(h, '' ORDER BY i) OVER after, '') AS s FROM node WHERE n > 1
  WINDOW before AS (PARTITION BY tree, lev, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY tree, lev, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tstep AS (SELECT lev, i, coalesce(string_agg(h, '' ORDER BY i) OVER before, '') || '|' || coalesce(string_agg(h, '' ORDER BY i) OVER after, '') AS s FROM top WHERE n > 1
  WINDOW before AS (PARTITION BY lev, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY lev, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
up AS (SELECT l.tree, l.i, list(s ORDER BY lev) AS steps FROM l JOIN step ON step.tree = l.tree AND step.i = l.i // (3 ** lev)::BIGINT GROUP BY ALL),
tup AS (SELECT t.i + 1 AS tree, list(s ORDER BY tstep.lev) AS steps FROM (SELECT i FROM top WHERE lev = 0) t JOIN tstep ON tstep.i = t.i // (3 ** tstep.lev)::BIGINT GROUP BY ALL),
way AS (SELECT l.*, coalesce(up.steps, []) AS a, coalesce(tup.steps, []) AS b FROM l LEFT JOIN up USING (tree, i) LEFT JOIN tup USING (tree)),
f AS (SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), a || b), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS fold, (SELECT h FROM top WHERE n = 1) AS root FROM way)
SELECT doc_id, leaf, (SELECT h FROM node WHERE node.n = 1 AND node.tree = f.tree) AS subroot, root, sha256(replace(array_to_string(a || b, ''), '|', '')) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f"""

ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op2_decontaminate": OP2, "op5_substring_dedup": OP5, "op11_manifest": OP11, "op13_conversations": OP13}
