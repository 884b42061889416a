"""DuckDB SQL for the operators that SQL can express on whole tables, written from their contracts."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"
#: words (doc_id, i from 1, v) of every document
_WORDS = f"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d)"""
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repeats(window: int) -> str:
    """Words covered by a window whose words also start in a document with a smaller doc_id."""
    return f"""WITH {_WORDS},
g AS (SELECT * FROM (SELECT doc_id, i, string_agg(v, ' ') OVER f AS k, count(*) OVER f AS n FROM v WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)) WHERE n = {window}),
h AS (SELECT doc_id, i FROM g JOIN (SELECT k, min(doc_id) AS lo FROM g GROUP BY k) USING (k) WHERE doc_id > lo),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM h, (SELECT unnest(range({window})) AS o)),
s AS (SELECT v.doc_id, count(r.i) AS n_removed, coalesce(string_agg(v, ' ' ORDER BY v.i) FILTER (r.i IS NULL), '') AS kept FROM v LEFT JOIN r ON v.doc_id = r.doc_id AND v.i = r.i GROUP BY v.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _windows(n: int) -> str:
    return f"SELECT doc_id, i, {n} AS n, k FROM (SELECT doc_id, i, string_agg(v, ' ') OVER f AS k, count(*) OVER f AS c FROM v WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE c = {n} AND {n} IN (SELECT n FROM b)"


DECONTAMINATE = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_PATTERN}') AS w FROM documents),
v AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_PATTERN}') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[j:j + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM t WHERE len(w) > 0)),
g AS ({" UNION ALL ".join(map(_windows, range(1, 14)))}),
m AS (SELECT g.doc_id, g.i, g.n, b.item_id FROM g JOIN b ON g.n = b.n AND g.k = b.k),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), (SELECT unnest(range(13)) AS o) WHERE o < n GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN x ON d.doc_id = x.doc_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i, len(w) AS c FROM d),
s AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, i, c, string_agg(v, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM v) WHERE i <= greatest(c - 3, 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS z FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * z >= 85 * (x.n + y.n - z)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
q AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT q.v, e.b FROM q JOIN e ON e.a = q.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN q ON q.v = d.doc_id GROUP BY d.doc_id, n"""

SQL = {"op2_suffix_dedup": repeats(32), "op5_decontaminate": DECONTAMINATE, "op9_substring_dedup": repeats(13), "op10_jaccard_join": JACCARD}
