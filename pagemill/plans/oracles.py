"""DuckDB SQL for the registered queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from pagemill.functions.text import STOP_WORDS
from pagemill.operators.answering import DOCUMENT_REQUESTS, NOT_FOUND, PARTIAL_NOTE

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+\z', '', 'g')"


def norm(x: str) -> str:
    x = rf"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for pattern, by in ((r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return strip(x)


def lines(x: str) -> str:
    return f"string_split_regex(coalesce({x}, ''), '{LINE_END}')"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({stop}))"


def url(x: str) -> str:
    return rf"regexp_matches(regexp_replace({x}, '[.,;:)\]}}]+\z', ''), '(?i)^(?:https?://|www\.)\S+$')"


SQL: dict[str, str] = {}

SQL["normalize_text"] = f"SELECT doc_id, {norm('text')} AS normal FROM documents"

SQL["tokenize"] = f"SELECT doc_id, len(w)::BIGINT AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)"

SQL["clean_lines"] = f"""
WITH l AS (SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) - 1 AS line_no FROM documents),
m AS (SELECT doc_id, line_no, repeat('# ', (line_no % 4)::BIGINT) || repeat('#', (doc_id % 3)::BIGINT) || line AS x FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, {strip(f"regexp_replace({strip('x')}, '^(?:#{SP}*)+', '')")} AS cleaned FROM m"""

SQL["printed_usable"] = rf"""
WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents),
c AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::BIGINT AS letters, length(regexp_replace(t, '{SP}', '', 'g'))::BIGINT AS marks FROM n)
SELECT doc_id, letters, marks, n >= 20 AND letters >= 0.5 * marks AS usable FROM c"""

SQL["url_lines"] = f"""
SELECT page_id, {url('url')} AS plain, {url("url || ').'")} AS closed, {url("'see ' || url")} AS spoken, {url("regexp_replace(url, '^https?://', 'WWW.')")} AS bare FROM pages"""

SQL["route_files"] = r"""
WITH f AS (SELECT page_id, 'f' || page_id || (['.PDF', '.txt', '.md', '.docx', '.png', '.JPG', '.jpeg', '.exe', '', '.tar.gz'])[page_id % 10 + 1] AS name FROM pages),
e AS (SELECT page_id, name AS document_name, CASE WHEN contains(name, '.') THEN lower('.' || list_last(string_split(name, '.'))) ELSE '' END AS extension FROM f)
SELECT *, CASE WHEN extension = '.pdf' THEN 'pdf' WHEN extension = '.docx' THEN 'docx' WHEN extension IN ('.txt', '.md') THEN 'plaintext'
  WHEN extension IN ('.png', '.jpg', '.jpeg') THEN 'image' END AS reader FROM e"""

PAGES = "pg AS (SELECT source AS document_name, doc_id::INTEGER AS page_number, coalesce(text, '') AS raw_text, doc_id % 7 = 0 AS has_image FROM documents)"
PAGE_LINES = f"""{PAGES},
pl AS (SELECT document_name, page_number, line_no, line, {strip('line')} AS s FROM (
  SELECT document_name, page_number, unnest({lines('raw_text')}) AS line, generate_subscripts({lines('raw_text')}, 1) AS line_no FROM pg) WHERE {strip('line')} <> ''),
bp AS (SELECT document_name, s AS line, count(DISTINCT page_number) AS n_pages, {url('s')} AS is_url FROM pl GROUP BY document_name, s),
noise AS (SELECT * FROM bp WHERE n_pages >= 2 OR is_url)"""
USABLE = f"""{PAGE_LINES},
us AS (SELECT pg.document_name, pg.page_number, pg.raw_text, pg.has_image, coalesce({strip("string_agg(k.line, chr(10) ORDER BY k.line_no)")}, '') AS usable_text
  FROM pg LEFT JOIN (SELECT pl.* FROM pl WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.document_name = pl.document_name AND n.line = pl.s)) k USING (document_name, page_number)
  GROUP BY pg.document_name, pg.page_number, pg.raw_text, pg.has_image),
rt AS (SELECT document_name, page_number, length({strip('raw_text')})::BIGINT AS raw_chars, length(usable_text)::BIGINT AS usable_chars,
  CASE WHEN length(usable_text) >= 20 THEN 'digital' WHEN length({strip('raw_text')}) >= 20 AND NOT has_image THEN 'drop' ELSE 'ocr' END AS route FROM us)"""

SQL["boilerplate_lines"] = f"WITH {PAGE_LINES} SELECT document_name, line, n_pages, is_url FROM noise"
SQL["usable_pages"] = f"WITH {USABLE} SELECT document_name, page_number, usable_text FROM us"
SQL["route_pages"] = f"WITH {USABLE} SELECT * FROM rt"
SQL["ocr_budget"] = f"""WITH {USABLE} SELECT document_name, count(*) AS n_pages, count(*) FILTER (route = 'digital') AS digital_pages, count(*) FILTER (route = 'drop') AS dropped_pages,
  count(*) FILTER (route = 'ocr') AS ocr_pages, count(*) FILTER (route = 'ocr') > 40 AS over_budget FROM rt GROUP BY document_name"""

INK = """ink AS (SELECT item_id AS image_id, r.r AS row, 200 AS width,
  CASE WHEN (r.r + item_id * 3) % (item_id % 7 + 17) < (item_id % 5 + 9) AND r.r % 29 <> 0 THEN 40 ELSE 2 END AS ink FROM benchmark, range(120) r(r)),
runs AS (SELECT image_id, min(row) AS s, max(row) + 1 AS e FROM (SELECT *, row - row_number() OVER (PARTITION BY image_id ORDER BY row) AS g FROM ink WHERE ink >= 3) GROUP BY image_id, g),
gaps AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY image_id ORDER BY s) <= 4 THEN 0 ELSE 1 END AS fresh FROM runs),
merged AS (SELECT image_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY s) AS g FROM gaps) GROUP BY image_id, g),
bands AS (SELECT image_id, s AS start, e AS "end" FROM merged WHERE e - s BETWEEN 8 AND 400)"""
SQL["line_bands"] = f"WITH {INK} SELECT * FROM bands"
SQL["ink_columns"] = f"""WITH {INK},
px AS (SELECT image_id, row, unnest([10 + row % 13, 150 + image_id % 60]) AS col FROM ink WHERE ink > 10 AND image_id % 4 > 0)
SELECT b.image_id, b.start, b."end", coalesce(greatest(0, min(p.col) - 6), 0)::BIGINT AS "left", coalesce(least(200, max(p.col) + 7), 200)::BIGINT AS "right"
FROM bands b LEFT JOIN (SELECT * FROM px WHERE col < 200) p ON p.image_id = b.image_id AND p.row >= b.start AND p.row < b."end" GROUP BY 1, 2, 3"""

CHUNKS = rf"""tx AS (SELECT source, doc_id, {norm('text')} AS t FROM documents),
st AS (SELECT doc_id, 0 AS k, 0 AS s FROM tx WHERE t <> ''
  UNION ALL SELECT doc_id, k + 1, greatest(s + 1, e - 60) FROM (
    SELECT doc_id, k, s, n, CASE WHEN s + 400 >= n THEN n WHEN b >= 180 THEN s + b + 1 ELSE s + 400 END AS e FROM (
      SELECT st.doc_id, k, s, length(t) AS n, length(regexp_extract(substr(t, s + 1, 400), '(?s)^(.*)(?:[.?!;:] |\n)', 1)) AS b FROM st JOIN tx USING (doc_id))) WHERE e < n),
ct AS (SELECT source, doc_id, k, {strip('substr(t, s + 1, CASE WHEN s + 400 >= length(t) THEN length(t) - s WHEN b >= 180 THEN b + 1 ELSE 400 END)')} AS text FROM (
  SELECT tx.source, st.doc_id, k, s, t, length(regexp_extract(substr(t, s + 1, 400), '(?s)^(.*)(?:[.?!;:] |\n)', 1)) AS b FROM st JOIN tx USING (doc_id))),
ch AS (SELECT source AS document_name, lower(source) AS document_key, doc_id::INTEGER AS page_number, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1)::INTEGER AS chunk_index FROM ct WHERE text <> '')"""
SQL["chunk_pages"] = f"""WITH RECURSIVE {CHUNKS} SELECT document_name, page_number, chunk_index, page_number || '-' || chunk_index AS chunk_id, sha256(document_key || '/0/' || chunk_index) AS id, text FROM ch"""

PACKED = f"""ln AS (SELECT doc_id, line_no, {strip('line')} AS t, ((doc_id * 31 + line_no * 17) % 100)::DOUBLE / 100.0 AS c FROM (
  SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) - 1 AS line_no FROM documents) WHERE {strip('line')} <> ''),
dl AS (SELECT doc_id, list(t ORDER BY line_no) AS ts, list(c ORDER BY line_no) AS cs, list(p ORDER BY line_no) AS p FROM (
  SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS p FROM ln) GROUP BY doc_id),
d2 AS (SELECT doc_id, ts, cs, list_prepend(0, p) AS p, len(ts) AS n FROM dl),
pk AS (SELECT doc_id, 0 AS position, 0::BIGINT AS s, greatest(1, len(list_filter(p, lambda v: v <= 400)) - 1)::BIGINT AS e FROM d2
  UNION ALL SELECT doc_id, position + 1, s2, greatest(e + 1, len(list_filter(p, lambda v: v <= p[s2 + 1] + 400)) - 1)::BIGINT FROM (
    SELECT doc_id, position, e, p, CASE WHEN p[e + 2] - p[tail + 1] <= 400 THEN tail ELSE e END AS s2 FROM (
      SELECT pk.doc_id, position, s, e, p, greatest(s, least(e - 1, len(list_filter(p, lambda v: v < p[e + 1] - 60)))) AS tail FROM pk JOIN d2 USING (doc_id) WHERE e < n))),
packed AS (SELECT doc_id, position, array_to_string(ts[s + 1:e], chr(10)) AS text, list_min(cs[s + 1:e]) AS ocr_confidence FROM pk JOIN d2 USING (doc_id))"""
SQL["pack_lines"] = f"WITH RECURSIVE {PACKED} SELECT * FROM packed"

SQL["page_confidence"] = f"""WITH RECURSIVE {PACKED} SELECT d.doc_id, round(coalesce(avg(c), 0.0), 6) AS confidence FROM documents d LEFT JOIN ln USING (doc_id) GROUP BY d.doc_id"""

SQL["word_confidence"] = f"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id, ((doc_id * 13 + i * 7) % 102 - 1)::DOUBLE AS conf FROM w WHERE {strip('w')} <> '')
SELECT d.doc_id, round(sum(conf) / (count(conf) * 100.0::DOUBLE), 4) AS confidence FROM documents d LEFT JOIN (SELECT * FROM c WHERE conf >= 0) c USING (doc_id) GROUP BY d.doc_id"""

SQL["sequence_confidence"] = """
WITH s AS (SELECT doc_id, s.s AS step, (doc_id + (s.s + 1) * (s.s + 1)) % 5 AS token FROM documents, range(9) s(s) WHERE s.s <= doc_id % 9),
p AS (SELECT doc_id, step, token, v.v AS v, exp(((doc_id * 7 + step * 3 + v.v * 5) % 11)::DOUBLE / 2.0) AS e FROM s, range(5) v(v)),
q AS (SELECT doc_id, step, sum(e) FILTER (v = token) / sum(e) AS prob FROM p WHERE token NOT IN (0, 1) GROUP BY doc_id, step)
SELECT d.doc_id, round(coalesce(avg(prob), 0.0), 6) AS confidence FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id"""

SQL["accepted_print"] = rf"""
WITH n AS (SELECT doc_id, {norm('text')} AS t, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 100)::DOUBLE / 100.0 END AS conf FROM documents),
a AS (SELECT *, conf IS NOT NULL AND length(t) >= 20 AND 2 * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= length(regexp_replace(t, '{SP}', '', 'g')) AS ok FROM n)
SELECT doc_id, CASE WHEN ok THEN length(t) ELSE 4 END::BIGINT AS n_chars, CASE WHEN ok THEN 'digital_text' ELSE 'handwritten_ocr' END AS content_type,
  CASE WHEN ok THEN 'pytesseract' ELSE 'trocr' END AS method, CASE WHEN ok THEN conf ELSE 0.5 END AS confidence FROM a"""

LEXICAL = f"""{CHUNKS},
qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS document_key, text AS question FROM benchmark),
tk AS (SELECT document_key, chunk_index, unnest({tokens('text')}) AS token FROM ch),
po AS (SELECT document_key, chunk_index, token, count(*) AS tf FROM tk GROUP BY ALL),
le AS (SELECT document_key, chunk_index, len({tokens('text')}) AS length FROM ch),
dc AS (SELECT document_key, count(*) AS n, sum(length)::DOUBLE / count(*) AS mean FROM le GROUP BY ALL),
rw AS (SELECT po.document_key, token, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM po JOIN dc USING (document_key) GROUP BY po.document_key, token),
mi AS (SELECT document_key, sum(raw) / count(*) AS mean_raw FROM rw GROUP BY ALL),
qt AS (SELECT query_id, document_key, token, count(*) AS qtf FROM (SELECT query_id, document_key, unnest({tokens('question')}) AS token FROM qs) GROUP BY ALL),
bs AS (SELECT query_id, document_key, chunk_index, any_value(n) AS n,
  round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean_raw ELSE raw END) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 6) AS score
  FROM qt JOIN po USING (document_key, token) JOIN rw USING (document_key, token) JOIN mi USING (document_key) JOIN le USING (document_key, chunk_index) JOIN dc USING (document_key) GROUP BY query_id, document_key, chunk_index),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM bs) WHERE rank <= least(greatest(24, n // 20), 40) AND score > 0)"""
FUSED = f"""{LEXICAL},
nr AS (SELECT document_key, chunk_index, sum(tf * tf) AS cc FROM po GROUP BY ALL),
nq AS (SELECT query_id, sum(qtf * qtf) AS qq FROM qt GROUP BY ALL),
bg AS (SELECT query_id, document_key, chunk_index, round(sum(qtf * tf)::DOUBLE / (sqrt(any_value(cc)::DOUBLE) * sqrt(any_value(qq)::DOUBLE)), 6) AS score
  FROM qt JOIN po USING (document_key, token) JOIN nr USING (document_key, chunk_index) JOIN nq USING (query_id) GROUP BY ALL),
dn AS (SELECT * FROM (SELECT bg.*, n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM bg JOIN dc USING (document_key)) WHERE rank <= least(greatest(24, n // 20), 40)),
fz AS (SELECT coalesce(dn.query_id, lx.query_id) AS query_id, coalesce(dn.document_key, lx.document_key) AS document_key, coalesce(dn.chunk_index, lx.chunk_index) AS chunk_index,
  round(coalesce(1.0::DOUBLE / (60 + dn.rank), 0) + coalesce(1.0::DOUBLE / (60 + lx.rank), 0), 6) AS rrf_score, coalesce(dn.rank, 1000000 + lx.rank) AS seen
  FROM dn FULL JOIN lx ON dn.query_id = lx.query_id AND dn.chunk_index = lx.chunk_index),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen) AS fused_rank FROM fz)"""
SQL["bm25_topk"] = f"WITH RECURSIVE {LEXICAL} SELECT query_id, rank::INTEGER AS rank, chunk_index, score FROM lx"
SQL["rrf_fuse"] = f"WITH RECURSIVE {FUSED} SELECT query_id, chunk_index, rrf_score, fused_rank::INTEGER AS fused_rank FROM fu"
SQL["hybrid_retrieve"] = f"""WITH RECURSIVE {FUSED},
cd AS (SELECT fu.*, sha256(fu.document_key || '/0/' || fu.chunk_index) AS id, ch.text, list_distinct({tokens('question')}) AS q, {tokens('ch.text')} AS w
  FROM fu JOIN ch USING (document_key, chunk_index) JOIN qs USING (query_id) JOIN dc ON dc.document_key = fu.document_key WHERE fused_rank <= least(greatest(24, n // 20), 40)),
rr AS (SELECT *, CASE WHEN len(q) = 0 THEN -6.0 ELSE round(12.0::DOUBLE * len(list_intersect(q, w)) / len(q) - 6.0::DOUBLE, 6) END AS rerank_score FROM cd),
nn AS (SELECT *, max(rerank_score) OVER (PARTITION BY query_id) AS best FROM rr),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, fused_rank) AS final_rank FROM nn WHERE rerank_score >= best - 2.5)
SELECT query_id, final_rank::INTEGER AS final_rank, chunk_index, rerank_score, rrf_score, id, substr(text, 1, 400) AS text FROM fr WHERE final_rank <= 6"""
SQL["dense_topk"] = """
WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_index, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM p) WHERE rank <= 24"""
SQL["overview_sample"] = f"""WITH RECURSIVE {CHUNKS},
pc AS (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY page_number, chunk_index) - 1 AS place, count(*) OVER (PARTITION BY document_key) AS total FROM ch),
pick AS (SELECT DISTINCT document_key AS dk, CASE WHEN total <= 10 THEN i.i ELSE floor(i.i * (total::DOUBLE / 10))::BIGINT END AS pl FROM pc, range(10) i(i))
SELECT document_name, chunk_index, page_number, text FROM pc JOIN pick ON dk = document_key AND pl = place"""

TYPED = "CASE WHEN page_number % 3 = 0 THEN 'handwritten_ocr' ELSE 'digital_text' END AS content_type, CASE page_number % 3 WHEN 0 THEN 'trocr' WHEN 1 THEN 'pytesseract' ELSE 'pymupdf' END AS extraction_method"
SQL["document_catalog"] = f"""WITH RECURSIVE {CHUNKS}, ty AS (SELECT *, {TYPED} FROM ch)
SELECT document_name, count(*) AS chunk_count, max(page_number) AS page_count, arg_min(content_type, chunk_index) AS content_type, arg_min(extraction_method, chunk_index) AS extraction_method FROM ty GROUP BY document_name"""
SQL["upload_summary"] = f"""WITH RECURSIVE {CHUNKS}, {PAGES}, ty AS (SELECT *, {TYPED} FROM pg),
a AS (SELECT document_name, count(*) AS page_count, count(*) FILTER (extraction_method IN ('trocr', 'pytesseract')) AS ocr_pages, string_agg(DISTINCT extraction_method, '+' ORDER BY extraction_method) AS methods,
  CASE WHEN count(DISTINCT content_type) = 1 THEN min(content_type) ELSE 'mixed' END AS content_type FROM ty GROUP BY document_name),
b AS (SELECT document_name, count(*) AS c FROM ch GROUP BY document_name)
SELECT a.*, coalesce(c, 0) AS chunk_count, CASE WHEN coalesce(c, 0) > 0 THEN 'INDEXED' ELSE 'FAILED' END AS status FROM a LEFT JOIN b USING (document_name)"""
SQL["document_scope"] = f"""WITH RECURSIVE {CHUNKS} SELECT document_key, count(*) AS n, max(chunk_index) AS last FROM ch
WHERE document_key IN (SELECT 'src' || (item_id % 20) FROM benchmark WHERE item_id % 3 = 0) GROUP BY document_key"""
GENERATIONS = "g AS (SELECT lower(source) AS document_key, doc_id, doc_id % 3 + length(source) % 2 AS generation FROM documents)"
SQL["latest_generation"] = f"WITH {GENERATIONS} SELECT document_key, generation, doc_id FROM g WHERE generation = (SELECT max(generation) FROM g h WHERE h.document_key = g.document_key)"
SQL["delete_document"] = f"WITH {GENERATIONS} SELECT document_key, doc_id FROM g WHERE document_key NOT IN ('src3', 'src7')"
SQL["store_health"] = f"WITH RECURSIVE {CHUNKS} SELECT count(DISTINCT document_key) AS documents, count(*) AS chunks FROM ch"
SQL["upload_limits"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Unsupported file type: .zip' WHEN strlen(text) > 3000 THEN 'larger than 3000 bytes' END AS error FROM documents"""

_PHRASES = "[" + ", ".join(f"'{p}'" for p in DOCUMENT_REQUESTS) + "]"
SQL["classify_question"] = f"""
WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN upper(({_PHRASES})[conv_id % 13 + 1]) || ' ' || text ELSE text END AS q FROM conversations)
SELECT conv_id, turn, len(list_filter({_PHRASES}, lambda p: contains(lower(q), p))) > 0 AS whole_document FROM q"""
SQL["trust_gate"] = f"""WITH RECURSIVE {PACKED},
s AS (SELECT doc_id, position, CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS t, CASE WHEN doc_id % 4 = 0 THEN 'handwritten_ocr' WHEN doc_id % 4 < 3 THEN 'digital_text' END AS kind,
  CASE WHEN doc_id % 5 > 0 THEN ocr_confidence END AS conf FROM packed)
SELECT doc_id, position, CASE WHEN t = '' THEN false WHEN conf IS NULL THEN kind IS DISTINCT FROM 'handwritten_ocr' ELSE conf >= 0.30 END AS trusted FROM s"""


def _labelled(x: str, n: int) -> str:
    return f"array_to_string(list_transform(string_split({x}, '. '), lambda x, i: x || ' [S' || ((i - 1) % {n} + 1) || ']'), ' ')"


DRAFTS = f"""tn AS (SELECT a.conv_id, a.turn, a.text AS reply, q.text AS question, a.conv_id + a.turn AS k FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user'),
sr AS (SELECT *, [{{'text': reply, 'page': turn::INTEGER, 'kind': 'digital_text', 'conf': NULL::DOUBLE}},
  {{'text': question, 'page': 0, 'kind': 'handwritten_ocr', 'conf': CASE WHEN k % 3 > 0 THEN (k % 10)::DOUBLE / 10.0 END}}, {{'text': '  ', 'page': NULL, 'kind': 'digital_text', 'conf': 0.9::DOUBLE}}] AS three FROM tn),
dr AS (SELECT conv_id, turn, k, question, CASE k % 11 WHEN 0 THEN three[3:3] WHEN 1 THEN three[2:2] WHEN 2 THEN three[1:1] ELSE three END AS sources,
  CASE k % 12 WHEN 0 THEN '{NOT_FOUND}' WHEN 1 THEN '[S1 | conv, page 1 | digital_text] ' || {_labelled('reply', 1)} WHEN 2 THEN reply WHEN 3 THEN {_labelled('reply', 9)}
  WHEN 4 THEN '{NOT_FOUND} ' || {_labelled('reply', 1)} WHEN 5 THEN 'made up | [S1] nowhere stated [S1] ' || {_labelled('reply', 1)} WHEN 6 THEN '[S1] [S2]' WHEN 7 THEN '[S1 | conv | digital_text]'
  WHEN 8 THEN 'never stated [S1]' ELSE {_labelled('reply', 1)} END AS draft,
  CASE k % 5 WHEN 0 THEN '{NOT_FOUND}' WHEN 1 THEN {_labelled('reply', 1)} WHEN 2 THEN '' ELSE {_labelled('reply', 4)} END AS retry FROM sr)"""


def _labels(x: str) -> str:
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\[S(\d+)\]', 1), lambda x: x::INTEGER)))"


def _real(x: str, n: str) -> str:
    return f"(len({_labels(x)}) > 0 AND len(list_filter({_labels(x)}, lambda x: x < 1 OR x > {n})) = 0)"


def _claims(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '(?s).*?\[S\d+\]'), lambda x: {strip('x')}), lambda x: NOT regexp_full_match(x, '\[S\d+\]'))"


def _unleaked(x: str) -> str:
    return strip("replace(" + strip(rf"regexp_replace({x}, '\[S\d+\s*\|[^\]]*\]', '', 'g')") + f", '{NOT_FOUND}', '')")


def _repaired(x: str) -> str:
    return rf"regexp_replace(regexp_replace({strip(x)}, '\[S\d+\]', '[S1]', 'g'), '(?:\[S1\]{SP}*)+', '[S1]', 'g')"


def _appended(x: str, n: str) -> str:
    return rf"CASE WHEN {n} = 1 AND NOT regexp_matches({x}, '\[S\d+\]') THEN {strip(x)} || ' [S1]' ELSE {x} END"


SQL["build_context"] = f"""WITH {DRAFTS}
SELECT conv_id, turn, array_to_string(list_filter(list_transform(sources, lambda s, i: CASE WHEN {strip('s.text')} <> '' THEN '[S' || i || ' | conv' || conv_id ||
  CASE WHEN coalesce(s.page, 0) <> 0 THEN ', page ' || s.page ELSE '' END || ' | ' || s.kind || ']' || chr(10) || {strip('s.text')} END), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context,
  CASE WHEN len(sources) = 1 THEN '[S1]' ELSE '[S1] to [S' || len(sources) || ']' END AS labels FROM dr"""
SQL["split_claims"] = f"WITH {DRAFTS} SELECT conv_id, turn, (generate_subscripts({_claims('draft')}, 1) - 1)::BIGINT AS pos, unnest({_claims('draft')}) AS claim FROM dr"
SQL["citation_check"] = rf"""WITH {DRAFTS} SELECT conv_id, turn, array_to_string({_labels('draft')}, ',') AS labels, regexp_matches(draft, '\[S\d+\]') AS cited, {_real('draft', 'len(sources)')} AS real,
  len(list_filter({_labels('draft')}, lambda x: x BETWEEN 1 AND len(sources)))::BIGINT AS resolved FROM dr"""
SQL["label_repair"] = f"WITH {DRAFTS} SELECT conv_id, turn, {_unleaked('draft')} AS stripped, {_appended('draft', 'len(sources)')} AS labelled, {_repaired('draft')} AS repaired FROM dr"
_BODY = strip(r"regexp_replace(lower(c), '\[s\d+\]', '', 'g')")
SQL["answer_state_machine"] = rf"""WITH {DRAFTS},
a AS (SELECT *, list_filter(sources, lambda s: {strip('s.text')} <> '') AS shown FROM dr),
b AS (SELECT *, list_filter(shown, lambda s: CASE WHEN s.conf IS NULL THEN s.kind <> 'handwritten_ocr' ELSE s.conf >= 0.30 END) AS trusted, {_unleaked('draft')} AS d1 FROM a),
c AS (SELECT *, len(trusted) AS n, {_appended('d1', 'len(trusted)')} AS d2 FROM b),
d AS (SELECT *, NOT {_real('d2', 'n')} AS again FROM c),
e AS (SELECT *, CASE WHEN again THEN {_unleaked('retry')} ELSE d2 END AS d3 FROM d),
f AS (SELECT *, CASE WHEN n = 1 AND NOT {_real('d3', '1')} THEN {_repaired('d3')} ELSE d3 END AS d4 FROM e),
g AS (SELECT *, {_claims('d4')} AS claims FROM f),
h AS (SELECT *, list_filter(claims[1:5], lambda c: NOT contains(c, '|') AND NOT contains(c, chr(10)) AND
  len(list_filter(trusted, lambda s: contains(lower(s.text), {_BODY}))) > 0) AS kept FROM g),
r AS (SELECT *, CASE WHEN len(shown) = 0 THEN 'no_evidence' WHEN n = 0 THEN 'low_handwriting_confidence' WHEN d1 = '' THEN 'not_answerable' WHEN again AND retry = '{NOT_FOUND}' THEN 'not_answerable'
  WHEN NOT {_real('d4', 'n')} THEN 'untraceable_citation' WHEN len(kept) = 0 THEN 'unsupported_claim' END AS reason FROM h)
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN array_to_string(kept, ' ') || CASE WHEN len(claims) > len(kept) THEN '{PARTIAL_NOTE}' ELSE '' END ELSE '{NOT_FOUND}' END AS answer, reason,
  CASE WHEN reason IS NULL THEN n ELSE 0 END::BIGINT AS n_sources, CASE WHEN reason IS NULL THEN len(claims) - len(kept) ELSE 0 END::BIGINT AS n_dropped FROM r"""
SQL["response_sources"] = f"""WITH {DRAFTS}, u AS (SELECT conv_id, turn, generate_subscripts(sources, 1) - 1 AS pos, unnest(sources) AS s FROM dr)
SELECT conv_id, turn, pos::BIGINT AS pos, 'conv' || conv_id AS filename, s.page AS page_number, substr(s.text, 1, 400) AS text, CASE WHEN turn % 4 = 1 THEN turn::DOUBLE / 10.0 ELSE 0.0 END AS score FROM u"""


def _form(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '{SP}+', ' ', 'g')")


SQL["error_rates"] = rf"""
WITH l AS (SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) - 1 AS line_no FROM documents),
t AS (SELECT doc_id, line_no, regexp_replace(line, '[^\x00-\x7f]', '#', 'g') AS t FROM l),
j AS (SELECT doc_id, line_no, {_form('t')} AS a, {_form("regexp_replace(t, '(?i)th| a |[.] ', ' ', 'g')")} AS b FROM t)
SELECT doc_id, line_no::BIGINT AS line_no, round(CASE WHEN a = '' THEN length(b) WHEN b = '' THEN length(a) ELSE levenshtein(a, b) END::DOUBLE / greatest(1, length(a)), 6) AS cer FROM j"""
