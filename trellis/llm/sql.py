"""DuckDB SQL of the operators' queries, where SQL can express one."""

from __future__ import annotations

from .mixing import CAP, SHARE, WEIGHTS
from .passages import WINDOW

_SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PASSAGES = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
 s AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS s, w FROM d WHERE len(w) >= {WINDOW} AND doc_id IS NOT NULL),
 win AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + {WINDOW - 1}], ' ')) AS h FROM s),
 first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
 hit AS (SELECT doc_id, s FROM win JOIN first USING (h) WHERE doc_id > first),
 gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM hit) GROUP BY doc_id),
 kept AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j}) % 32, 1)" for i in range(8) for j in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
 b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""

SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 60 * (x.n + y.n - o)),
 ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
 c AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
 k AS (SELECT a, count(*) AS k FROM ways GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k, 0)::BIGINT AS n_similar, least(doc_id, m)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.a = doc_id LEFT JOIN c ON c.a = doc_id"""

MIX = f"""
WITH d AS (SELECT doc_id, source, len({_SPLIT.format("text")})::BIGINT AS size, ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w, source_size * {CAP}.0::DOUBLE AS most FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS r FROM w),
 x AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(most) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS x FROM o),
 f AS (SELECT *, min(CASE WHEN x * w < most THEN r END) OVER () AS free FROM x),
 g AS (SELECT source, source_size, CASE WHEN r >= free THEN (SELECT y.x FROM f y WHERE y.r = y.free) * w ELSE most END AS target FROM f),
 t AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   round(target)::BIGINT AS budget FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - before)))::BIGINT AS taken FROM t"""

SQL = {"op4_repeated_passages": PASSAGES, "op8_warc": WARC, "op9_similar_documents": SIMILAR, "op10_mix_sources": MIX}
