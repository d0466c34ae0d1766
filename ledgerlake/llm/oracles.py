"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES
from .linededup import BLANKS, GRAM, WINDOW
from . import warc

_TRIM = "regexp_replace(line, '^[ \\t\\r\\x0b\\x0c]+|[ \\t\\r\\x0b\\x0c]+$', '', 'g')"


def _line_dedup() -> str:
    assert BLANKS == " \t\r\x0b\x0c"
    size = GRAM + WINDOW - 1
    lead = " || chr(10) || ".join(f"lead(s, {j}) OVER w" if j else "s" for j in range(size))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM docs),
solid AS (SELECT doc_id, ln, {_TRIM} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS n FROM raw WHERE {_TRIM} <> ''),
runs AS (SELECT doc_id, n, ln, {lead} AS run, lead(ln, {size - 1}) OVER w AS last FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, n) AS r FROM runs WHERE run IS NOT NULL),
later AS (SELECT doc_id, n, ln, last FROM ranked WHERE r > 1),
spans AS (SELECT doc_id, n, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT *, CASE WHEN n <= lag(n) OVER (PARTITION BY doc_id ORDER BY n) + {size} THEN 0 ELSE 1 END AS new FROM later)),
joined AS (SELECT doc_id, k, min(n) AS a, max(n) + {size} AS b FROM spans GROUP BY ALL),
counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_runs FROM joined GROUP BY doc_id),
cut AS (SELECT j.doc_id, x.ln AS first, y.ln AS last FROM joined j JOIN solid x ON x.doc_id = j.doc_id AND x.n = j.a JOIN solid y ON y.doc_id = j.doc_id AND y.n = j.b - 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM raw r WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.doc_id = r.doc_id AND r.ln BETWEEN c.first AND c.last) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def _license_scan() -> str:
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {t.key.split()!r}, {t.words!r}, {t.offset})" for t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
templates AS (SELECT * FROM (VALUES {rows}) t(label, base, key, notice, start)),
places AS (SELECT doc_id, words, unnest(list_filter(list_transform(words, lambda w, i: CASE WHEN list_contains(['gnu', 'apache', 'cc', 'cc0', 'mit', 'mozilla', 'redistribution', 'use'], w) THEN i END), lambda i: i IS NOT NULL)) AS i FROM docs),
found AS (SELECT doc_id, label, base, i - 1 AS word, len(list_filter(list_transform(notice, lambda w, j: i - start + j - 1 >= 1 AND coalesce(words[i - start + j - 1], '') = w), lambda x: x)) / len(notice) AS score
  FROM places JOIN templates ON words[i] = key[1] AND list_slice(words, i, i + len(key) - 1) = key),
summed AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(word) FILTER (base) AS first_word, max(word) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(s.n_base, 0) AS BIGINT) AS n_base, CAST(s.first_word AS BIGINT) AS first_word, CAST(s.last_word AS BIGINT) AS last_word, coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, CAST(coalesce(s.score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN summed s USING (doc_id)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _warc() -> str:
    def clean(x: str) -> str:
        for name, is_ in warc.ENTITIES:
            x = f"replace({x}, {_quoted(name)}, {_quoted(is_)})"
        x = f"regexp_replace({x}, '[ \\t\\r\\f\\x0b]+', ' ', 'g')"
        return f"regexp_replace(regexp_replace({x}, '\\s*\\n\\s*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"

    def cut(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {_quoted(pattern)}, {by}, 'g')"

    uid = lambda seed: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT sha256({seed}) AS h))"
    first = lambda pattern: f"regexp_extract(payload, {_quoted(pattern)}, 1)"
    text = clean(cut(cut(cut("payload", warc.HIDDEN, "''"), warc.BLOCK, "chr(10)"), warc.TAG, "''"))
    title = f"replace({clean(cut(first(warc.TITLE), warc.TAG, chr(39) * 2))}, chr(10), ' ')"
    nl = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, {uid("'response ' || coalesce(CAST(page_id AS VARCHAR), '') || ' ' || target_uri")} AS refers_to, 'sha256:' || sha256(payload) AS source_payload_digest FROM r),
d AS (SELECT page_id, target_uri, refers_to, source_payload_digest, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, {text} AS block FROM s
UNION ALL SELECT page_id, target_uri, refers_to, source_payload_digest, 'metadata', 'application/warc-fields', 'title: ' || {title} || {nl} || 'http-status: 200' || {nl} || 'http-content-type: text/html; charset=utf-8' || {nl} || 'language: ' || lower({first(warc.LANG)}) || {nl} || 'charset: ' || lower({first(warc.CHARSET)}) || {nl} || 'outlinks: ' || len(regexp_extract_all(payload, {_quoted(warc.LINK)})) || {nl} || 'source-length: ' || strlen(payload) || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl} FROM s)
SELECT page_id, record_type, {uid("record_type || ' ' || refers_to")} AS record_id, refers_to, target_uri, '{warc.DATE}' AS date, source_payload_digest, content_type, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_derivatives": _warc(), "op9_line_dedup": _line_dedup(), "op10_license_scan": _license_scan()}
