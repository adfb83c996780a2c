"""The results of queries for training data in DuckDB's SQL, where SQL can express them: plain definitions, no search."""

from __future__ import annotations

_RED = "regexp_replace(replace(lower({0}), '&', 'and'), '[^a-z0-9]+', '', 'g')"
_KEY = f"coalesce(nullif({_RED.format('course_key')}, ''), nullif({_RED.format('course_name')}, ''))"
_CODE = "CASE WHEN regexp_matches(coalesce(code, ''), '[0-9]') THEN regexp_replace(upper(code), '[^A-Z0-9]+', '', 'g') END"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_VERSION = "concat_ws(' ', array_to_string(list_transform(units, lambda u: u.text), ' '), array_to_string(list_transform(outcomes, lambda o: o.text), ' '))"
_LETTERS = "regexp_replace(lower({0}), '[^a-z]+', '', 'g')"
_LABEL = f"CASE WHEN coalesce({_LETTERS}, '') = '' THEN NULL WHEN starts_with('correct', {_LETTERS}) THEN 'correct' WHEN starts_with('wrong', {_LETTERS}) THEN 'wrong' END"
_VOTES = " + ".join(f"coalesce(({_LABEL.format(p)} = '{{0}}')::INT, 0)" for p in ("pass1", "pass2", "pass3"))
_SUPPORTED = f"CASE WHEN {_VOTES.format('correct')} >= 2 THEN 'correct' WHEN {_VOTES.format('wrong')} >= 2 THEN 'wrong' ELSE 'uncertain' END"

ORACLE = {
    "p2_found": f"""WITH RECURSIVE v AS (SELECT DISTINCT id, code, 'k' || {_KEY} AS a, 'c' || {_CODE} AS b FROM courses_small),
ed AS (SELECT DISTINCT a, b FROM v WHERE a IS NOT NULL AND b IS NOT NULL), dd AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT x, x AS y FROM dd UNION SELECT reach.x, dd.y FROM reach JOIN dd ON reach.y = dd.x),
root AS (SELECT x, min(y) AS r FROM reach GROUP BY x),
own AS (SELECT v.id, v.code, v.b, coalesce(root.r, v.a, v.b, 'i' || v.id) AS r FROM v LEFT JOIN root ON coalesce(v.a, v.b) = root.x),
g AS (SELECT r, substr(min(b), 2) AS group_code FROM own GROUP BY r)
SELECT DISTINCT own.id, g.group_code FROM own JOIN g USING (r) WHERE own.code IS DISTINCT FROM g.group_code""",
    "p4_found": f"""WITH v AS (SELECT DISTINCT ON (id) id, {_WORDS.format(_VERSION)} AS ws FROM courses_small), w AS (SELECT id, len(ws) AS n, unnest(ws) AS t FROM v),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM w a JOIN w b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL)
SELECT id_a, id_b FROM c WHERE k >= 0.75 * (na + nb - k)""",
    "p5_found": f"""WITH m AS (SELECT DISTINCT item, lower(trim(split)) AS split FROM course_membership), v AS (SELECT DISTINCT ON (id) id, units FROM courses_small),
u AS (SELECT v.id, generate_subscripts(units, 1) AS unit, unnest(units).text AS text, m.split = 'train' AS train FROM v JOIN m ON v.id = m.item),
x AS (SELECT id, unit, train, {_WORDS.format('text')} AS ws FROM u), w AS (SELECT id, unit, train, len(ws) AS n, unnest(ws) AS t FROM x),
c AS (SELECT a.id AS ia, a.unit AS ua, b.id AS ib, b.unit AS ub, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM w a JOIN w b ON a.t = b.t AND a.train AND NOT b.train AND a.id <> b.id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL)
SELECT least(ia, ib) AS id_a, CASE WHEN ia < ib THEN ua ELSE ub END AS unit_a, greatest(ia, ib) AS id_b, CASE WHEN ia < ib THEN ub ELSE ua END AS unit_b FROM c WHERE k >= 0.75 * (na + nb - k)""",
    "p6_found": f"""SELECT DISTINCT item, {_SUPPORTED} AS label FROM jdskills_llm WHERE coalesce({_LABEL.format('consensus')}, 'uncertain') <> {_SUPPORTED}""",
    "p6_agreement": f"""WITH r AS (SELECT DISTINCT item, {', '.join(f"{_LABEL.format(f'pass{i}')} AS p{i}, coalesce(nullif(upper(trim(regexp_replace(pass{i}_by, '\\s+', ' ', 'g'))), ''), '?') AS b{i}" for i in (1, 2, 3))} FROM jdskills_llm),
v AS (SELECT DISTINCT item, 1 AS p, b1 AS by, p1 AS label FROM r WHERE p1 IS NOT NULL UNION ALL SELECT DISTINCT item, 2, b2, p2 FROM r WHERE p2 IS NOT NULL UNION ALL SELECT DISTINCT item, 3, b3, p3 FROM r WHERE p3 IS NOT NULL),
c AS (SELECT item, label, count(*) AS c FROM v GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY item) AS m FROM c QUALIFY m >= 2),
l AS (SELECT label, sum(c) AS n, sum(c * (c - 1) / (m - 1)) AS same FROM m GROUP BY 1), t AS (SELECT sum(n) AS n, sum(same) AS same, sum(n * n) AS nn FROM l)
SELECT (SELECT count(DISTINCT item) FROM m) AS items, n::BIGINT AS votes, round((same / n)::DOUBLE, 9) AS agreement, round((1 - (1 - same / n) / ((n * n - nn) / (n * (n - 1))))::DOUBLE, 9) AS alpha FROM t""",
    "p7_found": r"SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) > 1024",
    "p8_found": """WITH i AS (SELECT item_no, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM heldout_items), ig AS (SELECT DISTINCT item_no, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT item_no, w, unnest(range(1, len(w) - 13)) AS k FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), dg AS (SELECT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d))
SELECT DISTINCT doc_id, item_no FROM dg JOIN ig USING (g)""",
    "p9_found": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400), g AS (SELECT doc_id, md5(substr(text, k, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM d)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1), x AS (SELECT DISTINCT doc_id, h FROM g SEMI JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shared": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM d),
g AS (SELECT doc_id, k, md5(substr(text, k, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM d WHERE length(text) >= 400)),
t AS (SELECT doc_id, md5(text) AS t FROM d), s AS (SELECT h FROM g JOIN t USING (doc_id) GROUP BY h HAVING count(DISTINCT t) > 1), x AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM g SEMI JOIN s USING (h)),
v AS (SELECT doc_id, sum(least(400, coalesce(k - p, 400)))::BIGINT AS n FROM x GROUP BY 1), r AS (SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, CASE WHEN length(text) >= 400 THEN copies ELSE 1 END AS n_copies FROM c)
SELECT doc_id, n_chars, CASE WHEN n_copies > 1 THEN n_chars ELSE coalesce(n, 0) END AS shared_chars, round(CASE WHEN n_copies > 1 THEN n_chars ELSE coalesce(n, 0) END / greatest(n_chars, 1), 6) AS share, n_copies FROM r LEFT JOIN v USING (doc_id)""",
    "p9_groups": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400), g AS (SELECT doc_id, md5(substr(text, k, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM d)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1), x AS (SELECT DISTINCT doc_id, h FROM g SEMI JOIN s USING (h)), l AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_doc, count(*) OVER (PARTITION BY text) AS n_copies, coalesce(n, 0) AS n_links FROM d LEFT JOIN l USING (doc_id)""",
}
_ROOTS = ORACLE["p2_found"].split("g AS (SELECT r,")[0].rstrip().rstrip(",")
ORACLE["p2_check"] = f"{_ROOTS} SELECT count(DISTINCT id) AS n_versions, count(DISTINCT id) AS n_ids, count(DISTINCT r) AS n_groups, 0::BIGINT AS torn, true AS near_target FROM own"
_PAIRS = ORACLE["p4_found"].split("SELECT id_a, id_b FROM c WHERE")[0].replace("WITH v AS", "WITH RECURSIVE v AS", 1).rstrip()
ORACLE["p4_groups"] = f"""{_PAIRS}, pa AS (SELECT id_a, id_b FROM c WHERE k >= 0.75 * (na + nb - k)), ed AS (SELECT id_a AS x, id_b AS y FROM pa UNION ALL SELECT id_b, id_a FROM pa), reach AS (SELECT x, x AS y FROM ed UNION SELECT reach.x, ed.y FROM reach JOIN ed ON reach.y = ed.x), root AS (SELECT x, min(y) AS r FROM reach GROUP BY 1), nl AS (SELECT x, count(*) AS n FROM ed GROUP BY 1)
SELECT v.id, min(v.id) OVER (PARTITION BY list_sort(ws)) AS class_id, coalesce(r, v.id) AS group_id, coalesce(n, 0) AS n_links FROM v LEFT JOIN root ON root.x = v.id LEFT JOIN nl ON nl.x = v.id WHERE len(ws) > 0"""
ORACLE["p7_check"] = r"""WITH t AS (SELECT DISTINCT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x85\x1c-\x1f]+')) AS n FROM documents)
SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, 0::BIGINT AS divided, 0::BIGINT AS wrong, 0::BIGINT AS overfull, true AS filled FROM t"""
ORACLE["p8_items"] = f"SELECT item_no, count(*) AS n_documents, min(doc_id) AS first_doc FROM ({ORACLE['p8_found']}) GROUP BY 1"
