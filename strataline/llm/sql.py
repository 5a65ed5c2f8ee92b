"""The same rows as some queries give, in DuckDB's SQL."""

from __future__ import annotations

from . import quality

URL_FILTER = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, v)),
f AS (SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT html, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to FROM p LEFT JOIN k ON k.html = p.html
"""

_SPACE = r"[\x20\x09-\x0D]"
# in the order of the classes of quality._class_table
_CLASSES = ["[aeiou]", "[b-df-hj-np-tv-z]", "[A-Z]", "[0-9]", " ", r"[\x09-\x0D]", r"[.,;:!?'\"()\-]", None, r"[^\x00-\x7F]"]


def _count(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"(length(text) - length(regexp_replace(text, '{quoted}', '', 'g')))"


def quality_rules() -> str:
    counts = [None if p is None else _count(p) for p in _CLASSES]
    counts[7] = "(length(text) - " + " - ".join(c for c in counts if c) + ")"
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.BINS)
    limit = lambda pair: f"{pair[0]!r} + {pair[1]!r} / sqrt(greatest(n_words, 1))"
    half = "sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, 'und') AS lang FROM documents),
w AS MATERIALIZED (SELECT rid, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, word || chr(31) || lead(word) OVER o || chr(31) || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) s(k) GROUP BY rid),
nw AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
b AS MATERIALIZED (SELECT d.rid, doc_id, lang, coalesce(nw.n, 0) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, {_count('[#*$%&|<>]')} AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(text) AS n_chars, [{', '.join(counts)}] AS classes FROM d LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN nw ON nw.rid = d.rid),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
lg AS (SELECT lang, count(*) AS n FROM f WHERE NOT base_failed GROUP BY lang),
cp AS (SELECT rid, lang, base_failed, n_words, unnest(range(1, 10)) AS bin, unnest(list_transform(classes, lambda x: x / greatest(n_chars, 1))) AS p FROM f),
cq AS (SELECT cp.lang, bin, sum(p) / any_value(lg.n) AS q FROM cp JOIN lg ON lg.lang = cp.lang WHERE NOT base_failed GROUP BY 1, 2),
cd AS (SELECT rid, sqrt(greatest(0, least(1, {half} / 2))) AS dist FROM cp JOIN cq USING (lang, bin) WHERE n_words >= 50 GROUP BY rid),
wp AS MATERIALIZED (SELECT rid, CASE WHEN word IN ({words}) THEN word ELSE '' END AS bin, count(*) AS c FROM w GROUP BY 1, 2),
ws AS (SELECT wp.rid, f.lang, base_failed, bin, c / f.n_words AS p FROM wp JOIN f ON f.rid = wp.rid WHERE f.n_words >= 50),
wq AS (SELECT ws.lang, bin, sum(p) / any_value(lg.n) AS q FROM ws JOIN lg ON lg.lang = ws.lang WHERE NOT base_failed GROUP BY 1, 2),
wd AS (SELECT rid, sqrt(greatest(0, least(1, ({half} + 1 - sum(q)) / 2))) AS dist FROM (SELECT ws.rid, ws.lang, p, coalesce(q, 0) AS q FROM ws LEFT JOIN wq ON wq.lang = ws.lang AND wq.bin = ws.bin) JOIN lg USING (lang) GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd.dist, 0) <= {limit(quality.CHAR_LIMIT)} AND coalesce(wd.dist, 0) <= {limit(quality.WORD_LIMIT)} AS kept, round(cd.dist, 6) AS char_distance, round(wd.dist, 6) AS word_distance
FROM f LEFT JOIN cd ON cd.rid = f.rid LEFT JOIN wd ON wd.rid = f.rid
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": URL_FILTER, "op4_quality_rules": quality_rules(), "op7_warc": WARC}
