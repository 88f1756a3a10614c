"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from gridloom.llm import licenses, secrets

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UP}', '{LOW}'), '{breaks}'), lambda x: x <> '')"


ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Plain words and numbers, joined.
JOINED = r"^[-_/=+]*([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*$"


def decontamination(width: int = 13) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text', ALNUM)} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_words('text', ALNUM)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({width}, len(w)) AS l, array_to_string(w[s : s + least({width}, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, l, s, array_to_string(w[s : s + l - 1], ' ') AS t FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT rid, item_id, s, dw.l FROM dw JOIN iw ON iw.l = dw.l AND iw.t = dw.t),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM h) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


def proximity(width: int = 13, near: int = 10) -> str:
    ctes, last = decontamination(width).rsplit("\nSELECT ", 1)
    line = "PARTITION BY rid, gid, pos - ipos ORDER BY ipos RANGE BETWEEN"
    return f"""{ctes},
gi AS (SELECT row_number() OVER () AS gid, item_id, w FROM i WHERE len(w) > 0),
ip AS (SELECT gid, item_id, len(w) AS size, unnest(range(1, len(w) + 1)) AS ipos, unnest(w) AS word FROM gi),
dp AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
ag AS (SELECT rid, gid, item_id, size, ipos, pos FROM dp JOIN ip USING (word)),
ac AS (SELECT *, count(*) OVER ({line} {width - 1} PRECEDING AND CURRENT ROW) AS k FROM ag),
cl AS (SELECT rid, item_id, pos FROM (SELECT *, max(CASE WHEN k >= least({near}, size) THEN 1 ELSE 0 END) OVER ({line} CURRENT ROW AND {width - 1} FOLLOWING) AS c FROM ac) WHERE c = 1),
cn AS (SELECT rid, count(DISTINCT pos) AS n_near FROM cl GROUP BY rid),
cm AS (SELECT rid, count(*) AS n_near_items, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM (SELECT DISTINCT rid, item_id FROM cl) GROUP BY rid)
SELECT CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256, {last} LEFT JOIN cn USING (rid) LEFT JOIN cm USING (rid)"""


def near_duplicates(width: int = 5, percent: int = 75) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text', SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + {width - 1}], ' ') AS t, least(len(w), {width}) AS l FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.l = b.l AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS s, a AS t FROM g UNION SELECT r.s, g.b FROM r JOIN g ON g.a = r.t),
m AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _spans(kind: int, pattern: str, group: int, where: str) -> str:
    """(rid, start, kind, end, value) of one pattern's matches that satisfy where (over v, the group's text)."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, s AS start, {kind} AS kind, s + length(whole) AS stop, whole AS value FROM (
SELECT rid, whole, v, sum(length(gap)) OVER (PARTITION BY rid ORDER BY k) + coalesce(sum(length(whole)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS whole, unnest(g) AS v, unnest(b[1 : len(w)]) AS gap FROM (
SELECT rid, regexp_extract_all(text, '{p}') AS w, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS b FROM d WHERE regexp_matches(text, '{p}')))) WHERE {where}"""


def secret_spans() -> str:
    w = secrets.WINDOW
    assign = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" for c in x) for x in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
    allow = " OR ".join(f"regexp_matches(value, '{p}')" for p in (*secrets.ALLOW, JOINED))
    t = secrets.THRESHOLDS
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    text = f"{kinds}[kind + 1] || ':' || start || ':' || stop"
    listed = f"string_agg({text}, ',' ORDER BY start, kind, stop)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS ({_spans(0, assign, 1, 'length(v) >= 8')} UNION ALL {_spans(1, secrets.ACCESS, 0, 'true')} UNION ALL {_spans(2, secrets.HEX, 0, 'true')}),
c AS ({_spans(3, secrets.CANDIDATE, 0, 'true')}),
o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = c.rid AND b.start <= c.start AND b.stop >= c.stop) AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT ({allow})),
x AS (SELECT *, list_max(list_transform(range(1, length(value) - {w} + 2), lambda i: round(list_aggregate(string_split(substring(value, i, {w}), ''), 'entropy'), 9))) AS h FROM o),
e AS (SELECT rid, start, kind, stop, value FROM x WHERE h >= CASE WHEN regexp_matches(value, '^[0-9A-Fa-f]+$') THEN {t['hex']} WHEN regexp_matches(value, '^[A-Za-z0-9]+$') THEN {t['alnum']} ELSE {t['base64']} END),
p AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {listed} AS spans FROM b GROUP BY rid),
q AS (SELECT rid, {listed} AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(p.spans, '')) AS base_sha256, coalesce(q.spans, '') AS spans FROM d LEFT JOIN p USING (rid) LEFT JOIN q USING (rid)"""


def license_notices() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    k = licenses.WIDTH
    cut = f"SELECT DISTINCT {{key}}, array_to_string(w[k : k + {k - 1}], ' ') AS t FROM (SELECT {{key}}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS k FROM {{table}} WHERE len(w) > 0)"
    return f"""WITH n AS (SELECT name, {_words('notice', ALNUM)} AS w FROM (VALUES {rows}) v(name, notice)), d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text', ALNUM)} AS w FROM documents),
ns AS ({cut.format(key='name', table='n')}), ds AS ({cut.format(key='rid', table='d')}), nn AS (SELECT name, count(*) AS n FROM ns GROUP BY name),
m AS (SELECT rid, name, count(*) / any_value(CAST(n AS DOUBLE)) AS c FROM ds JOIN ns USING (t) JOIN nn USING (name) GROUP BY rid, name),
f AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(c) AS best FROM m WHERE c >= {licenses.CONTAINMENT} GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0), 6) AS best FROM d LEFT JOIN f USING (rid)"""

