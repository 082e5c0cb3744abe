"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, len(list_slice(ws, i, i + 7)) AS k, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM item WHERE len(ws) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
), sizes AS (
  SELECT DISTINCT k FROM item_window
), doc_window AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM doc, sizes WHERE len(ws) >= k)
), hit AS (
  SELECT d.doc_id, d.k, d.i, w.item_id FROM doc_window d JOIN item_window w ON d.win = w.win AND d.k = w.k
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS place FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(t.n_items, 0) >= 2 AS contaminated
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""

OP4 = """
WITH rec AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(html) AS mark,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
)
SELECT page_id, CAST(page_id // 512 AS VARCHAR) || '-0' AS file,
  row_number() OVER w - 1 AS place, CAST(1 AS BIGINT) AS copies, sha256(record) AS record_sha256,
  CAST(sum(strlen(record)) OVER w - strlen(record) AS BIGINT) AS begin_offset,
  CAST(sum(strlen(record)) OVER w AS BIGINT) AS end_offset,
  CASE WHEN mark LIKE '00%' THEN 'corrupt' WHEN mark LIKE '01%' THEN 'missing' ELSE 'ok' END AS state
FROM rec WINDOW w AS (PARTITION BY page_id // 512 ORDER BY page_id)
"""

#: CRC-32 byte by byte over a table made by its rule; the walk of jump hashing in 128-bit integers.
OP7 = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT doc_id, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16
    + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS bs FROM hexed
), crc AS (
  SELECT doc_id, len(bs) + 1 AS size, xor(list_reduce(list_prepend(4294967295, bs),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab
), walk(doc_id, k, j, a, b) AS (
  SELECT doc_id, CAST(doc_id AS HUGEINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, k, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT),
    CASE WHEN j < 16 THEN j ELSE a END, CASE WHEN j < 17 THEN j ELSE b END
  FROM (SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k, j, a, b FROM walk WHERE j < 17)
), dealt AS (
  SELECT doc_id, a, b FROM walk WHERE j >= 17
)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, CAST(c.text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(d.a AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY d.a ORDER BY c.doc_id) - 1 AS slot, CAST(d.b AS INTEGER) AS grown_shard
FROM crc c JOIN dealt d ON d.doc_id = c.doc_id
"""

ORACLES = {"op1_decontamination": OP1, "op4_warc_audit": OP4, "op7_sharding": OP7}
