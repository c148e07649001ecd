"""DuckDB SQL of the training-data queries that SQL can express; the others are tested against brute-force versions."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(u: str) -> str:
    return f"coalesce(translate(regexp_extract(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END, '^[^/?#]*'), '{UP}', '{LOW}'), '')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '')"


def _plain(u: str) -> str:
    q = f"regexp_replace(regexp_replace('&' || coalesce(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^?#]*\\?([^#]*)', 1), ''), '&(utm_[a-z]+|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '')"
    return f"CASE WHEN instr({u}, '://') > 0 THEN {_host(u)} || {_path(u)} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


def _norm(u: str) -> str:
    return f"regexp_replace({_plain(u)}, '^([^?]*?)/+(\\?|$)', '\\1\\2')"


def _rule(h: str, p: str, out: int) -> str:
    rules = (("example.com/de/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("net/", "block"))
    cases = []
    for r in rules:
        host, path = r[0].split("/", 1)
        cases.append(f"WHEN ({h} = '{host}' OR suffix({h}, '.{host}')) AND prefix({p}, '/{path}') THEN '{r[out]}'")
    return "CASE " + " ".join(cases) + " END"


OP2 = f"""WITH RECURSIVE p AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_norm('trim(url)')} AS node, {_plain('trim(url)')} AS plain,
regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical["'']?[^>]*>'), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS can,
regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*?http-equiv\\s*=\\s*["'']?refresh["'']?[^>]*>'), '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS red FROM pages),
half AS (SELECT node AS u, {_norm('trim(can)')} AS v, plain AS u_at, {_plain('trim(can)')} AS v_at FROM p WHERE can <> '' UNION ALL SELECT node, {_norm('trim(red)')}, plain, {_plain('trim(red)')} FROM p WHERE red <> ''),
member AS (SELECT u AS node, u_at AS plain FROM half WHERE u <> v UNION SELECT v, v_at FROM half WHERE u <> v),
e AS (SELECT u, v FROM half WHERE u <> v UNION SELECT v, u FROM half WHERE u <> v),
reach AS (SELECT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM reach r JOIN e ON e.u = r.b),
said AS (SELECT a, min({_rule("regexp_extract(plain, '^[^/?]*')", "regexp_extract(plain, '^[^/?]*([^?]*)', 1)", 1)}) AS v FROM reach JOIN member ON node = b GROUP BY 1)
SELECT page_id, host, path, {_rule('host', 'path', 0)} AS rule, coalesce({_rule('host', 'path', 1)}, v, 'allow') AS verdict,
({_rule('host', 'path', 0)} IS NULL AND v IS NOT NULL) AS via_alias FROM p LEFT JOIN said ON p.node = said.a"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.v FROM reach r JOIN link l ON l.u = r.b)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(b) AS component_id FROM s JOIN reach ON s.doc_id = reach.a GROUP BY 1, 2"""

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP4 = f"""WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORDS}') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORDS}') AS w FROM documents),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
hit AS (SELECT doc_id, i, v.m, item_id FROM (SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)) v JOIN win USING (m, k)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLE_SQL = {"op2_url_filters": OP2, "op3_jaccard_join": OP3, "op4_decontamination": OP4}
