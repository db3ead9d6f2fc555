"""DuckDB SQL for the corpus queries that SQL can express."""


def _edit(state: str, cost: str, letter: str, line: str = "''", where: str = "true") -> str:
    """A state's best (cost, edits, lines) after one edit more; NULL where that is not allowed."""
    return f"CASE WHEN {state} IS NOT NULL AND {where} THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 'b': {state}.b || {line}}} END"


_USER, _ASSISTANT, _OWN = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_TO_USER = ", ".join(_edit(x, "cut", "K", _OWN, "NOT gone AND role[1] = 'u'") + ", " + _edit(x, "3 + cut", "R", f"{_USER} || text", "NOT gone") for x in ("s0", "s1", "s3"))
_TO_ASSISTANT = _edit("s2", "cut", "K", _OWN, "NOT gone AND role[1] = 'a'") + ", " + _edit("s2", "3 + cut", "R", f"{_ASSISTANT} || text", "NOT gone")
#: Edits go forward, row by row: the least (cost, edits) of every grammar state, then what can be inserted.
_REPAIR = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END))) % 20 AS code
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM raw)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS open,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
todo AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN open THEN 3 ELSE 0 END AS cut FROM judged),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'e': '', 'b': ''}} AS s0, CAST(NULL AS STRUCT(c INTEGER, e VARCHAR, b VARCHAR)) AS s1, {{'c': 3, 'e': 'I', 'b': {_USER}}} AS s2, {{'c': 6, 'e': 'II', 'b': {_USER} || {_ASSISTANT}}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, {_edit("s2", "3", "I", _ASSISTANT)}]) FROM (
    SELECT conv_id, i, s0, s1, list_min([s2, {_edit("s0", "3", "I", _USER)}, {_edit("s1", "3", "I", _USER)}, {_edit("s3", "3", "I", _USER)}]) AS s2, s3 FROM (
      SELECT best.conv_id, todo.i, {_edit("s0", "4", "D")} AS s0, list_min([{_edit("s1", "4", "D")}, {_edit("s0", "cut", "K", _OWN, "NOT gone AND role[1] = 's'")}]) AS s1,
        list_min([{_edit("s2", "4", "D")}, {_TO_USER}]) AS s2, list_min([{_edit("s3", "4", "D")}, {_TO_ASSISTANT}]) AS s3
      FROM best JOIN todo ON best.conv_id IS NOT DISTINCT FROM todo.conv_id AND todo.i = best.i + 1))),
done AS (SELECT conv_id, list_min([s0, s3]) AS s FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
fault AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT gone) AS truncated, count(*) FILTER (illegal) AS illegal FROM todo GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(s.c AS BIGINT) AS cost, s.e AS audit, sha256(substr(s.b, 2)) AS repaired_sha256
FROM done d LEFT JOIN fault f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""

ORACLES = {
    "op11_filter_audit": r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
label AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f FROM doc),
counts AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failing LEFT JOIN label USING (doc_id) GROUP BY part, f),
perm AS (SELECT '' AS o UNION ALL SELECT o || l FROM perm, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(l) WHERE NOT contains(o, l)),
steps AS (SELECT o, s, o[s] AS l, '[' || substr(o, 1, s - 1) || '-]' AS earlier FROM perm, (VALUES (1), (2), (3), (4), (5)) x(s) WHERE length(o) = 5),
cell AS (
  SELECT part, o, s, l, sum(n) FILTER (NOT contains(f, l) AND NOT regexp_matches(f, earlier)) AS kept, sum(n) FILTER (contains(f, l) AND NOT regexp_matches(f, earlier)) AS removed,
    sum(n) FILTER (contains(f, l) AND regexp_matches(f, earlier)) AS redundant, sum(n) FILTER (f = l) AS unique_fails,
    sum(good) FILTER (contains(f, l) AND NOT regexp_matches(f, earlier)) AS good_lost, sum(toxic) FILTER (contains(f, l) AND NOT regexp_matches(f, earlier)) AS toxic_lost
  FROM counts, steps GROUP BY part, o, s, l)
SELECT part, o AS filter_order, s AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM cell
""",
    "op13_conversation_repair": _REPAIR,
    "op10_decontamination": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
run AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, run.n, item FROM run JOIN win ON run.run = win.win AND run.n = win.n),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
""",
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
gram AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM doc)),
sized AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (
  SELECT x, y FROM common JOIN sized p ON p.r = x JOIN sized q ON q.r = y WHERE 5 * c >= 4 * (p.n + q.n - c)
  UNION SELECT a.r, b.r FROM doc a JOIN doc b ON a.text IS NOT DISTINCT FROM b.text AND a.r < b.r),
edge AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM doc UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
class AS (SELECT reach.x AS r, min(doc.doc_id) AS class_id FROM reach JOIN doc ON doc.r = reach.y GROUP BY reach.x),
degree AS (SELECT x AS r, count(*) AS n_links FROM edge GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM doc JOIN class USING (r) LEFT JOIN degree USING (r)
""",
}
