"""DuckDB SQL for those of the operators' queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
SQL["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, upper(sha1(h)) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || x[5 * i + 1:5 * i + 5])::BIGINT) AS v FROM q)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr({_BASE32}, (((v[i // 4 + 1] >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""

SQL["op5_substring"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS d FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k.k AS j FROM (SELECT x.doc_id, x.i FROM x JOIN m USING (h) WHERE m.d < x.doc_id), range(50) k(k)),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.j) AS kept, count(*) AS n FROM a ANTI JOIN gone USING (doc_id, j) GROUP BY a.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

SQL["op10_suffix"] = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 199)) AS p FROM t)),
r AS (SELECT doc_id, p FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
b AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY doc_id, n),
c AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM b),
o AS (SELECT t.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, any_value(substr(x, 1, 2 * a)) FILTER (k = 1) || string_agg(substr(x, 2 * z + 1, coalesce(2 * (after - z), length(x))), '' ORDER BY a) AS kept
  FROM c JOIN t USING (doc_id) GROUP BY t.doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN o USING (doc_id)"""
