"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .filter_audit import MAX_CAPITALS_PERCENT, MIN_DISTINCT_PERCENT, MIN_WORDS, SIGNS
from .mixing import MAX_REPEATS, WEIGHTS
from .term_divergence import MIN_DOCUMENTS, SCALE, SHOWN_TERMS
from .url_filter import REJECT_AT, RULES, VOCABULARY

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"

MIXING = f"""
WITH doc AS (SELECT doc_id, source, coalesce({_WORDS}, 0)::BIGINT AS size, coalesce(length(text), 0) AS chars FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM doc GROUP BY source),
weighted AS (SELECT *, ({list(WEIGHTS)})[((place - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS w, source_size * {MAX_REPEATS} AS ceiling FROM src),
stepped AS (SELECT *, coalesce(sum(ceiling) OVER b, 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left, sum(source_size) OVER () AS total,
  row_number() OVER (ORDER BY ceiling / w, place) AS step FROM weighted WINDOW b AS (ORDER BY ceiling / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (total - stopped) / w_left AS level FROM stepped),
opened AS (SELECT *, min(CASE WHEN level < ceiling / w THEN step END) OVER () AS first_open FROM levelled),
target AS (SELECT source, source_size, CASE WHEN step < coalesce(first_open, 2147483647) THEN ceiling::DOUBLE ELSE w * max(CASE WHEN step = first_open THEN level END) OVER () END AS target FROM opened),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM target),
keyed AS (SELECT doc.*, source_size, target, epochs, target - epochs * source_size AS rest,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656) / CASE WHEN size >= 50 AND chars >= 3 * size AND chars <= 11 * size THEN 1.0 ELSE 0.5 END AS key
  FROM doc JOIN plan ON doc.source IS NOT DISTINCT FROM plan.source),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed"""


def _rules(verdict: bool) -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{kind if verdict else h + p}'" for kind, h, p in longest_first)
    return f"CASE {' '.join(cases)} END"


_TERMS = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())

URLS = rf"""
WITH split AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
vocabulary(term, weight) AS (VALUES {_TERMS}),
heavy AS (SELECT url FROM (SELECT DISTINCT url FROM pages) u, vocabulary WHERE contains(lower(url), term) AND regexp_matches(lower(url), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY url HAVING sum(weight) >= {REJECT_AT})
SELECT page_id, host, path, {_rules(False)} AS rule, coalesce({_rules(True)}, CASE WHEN url IN (SELECT url FROM heavy) THEN 'block' ELSE 'allow' END) AS verdict FROM split"""

TOP_K = """
WITH vec AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_dot_product(q.v, c.v)::BIGINT AS score FROM vec q, vec c WHERE q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

_BASE32 = "list_aggregate(list_transform(range(0, 8), lambda i: {0}), 'string_agg', '')".format(
    " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
)
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner,
  row_number() OVER (PARTITION BY coalesce(html, ''), page_id ORDER BY url NULLS LAST) AS nth FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN owner IS NULL OR page_id = owner AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM owner OR nth > 1 THEN owner END AS refers_to FROM p"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FILTER_AUDIT = rf"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
judged AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {MIN_DISTINCT_PERCENT} * len(ws))::INT
  + 4 * (100 * (length(t) - length(translate(t, '{_LETTERS}', ''))) > {MAX_CAPITALS_PERCENT} * length(t))::INT + 8 * regexp_matches(t, '{SIGNS}')::INT
  + 16 * coalesce(doc.doc_id <> min(doc.doc_id) OVER (PARTITION BY t), min(doc.doc_id) OVER (PARTITION BY t) IS NOT NULL)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM doc LEFT JOIN judged ON doc.doc_id = judged.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
state AS (SELECT p.part, s.s, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM (SELECT DISTINCT part FROM cell) p CROSS JOIN range(0, 32) s(s) LEFT JOIN cell ON cell.part = p.part AND (mask & s.s) = 0 GROUP BY p.part, s.s),
letter AS (SELECT chr((65 + i)::INT) AS f, (1 << i)::BIGINT AS bit FROM range(0, 5) i(i)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letter a, letter b, letter c, letter d, letter e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
step AS (SELECT o, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) i(i)),
done AS (SELECT x.part, o AS filter_order, step, y.n AS kept, x.n - y.n AS removed, bit, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost FROM step JOIN state x ON x.s = before JOIN state y ON y.s = before + bit AND y.part = x.part),
alone AS (SELECT part, bit, coalesce(sum(n) FILTER (WHERE mask & bit > 0), 0) AS fails, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS only_it FROM cell, letter GROUP BY part, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant, only_it::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done JOIN alone USING (part, bit)"""

_GAP = "((a.p - b.p) * (a.p - b.p)) // b.p"
DIVERGENCE = rf"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
hit AS (SELECT lang, source, r, unnest(ws) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM hit GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
whole AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
used AS (SELECT hit.lang, source, term, count(*) AS n FROM hit JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN used USING (lang, source) GROUP BY lang, source),
dense AS (SELECT lang, source, term, coalesce(used.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(used.n, 0) + 1)) // (size.total + v) AS p FROM size JOIN whole USING (lang) JOIN kept USING (lang) LEFT JOIN used USING (lang, source, term)),
of_lang AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (kept.n + 1)) // (total + v) AS p FROM kept JOIN whole USING (lang)),
meet AS (SELECT lang, a.source, b.source AS item, sum({_GAP}) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN meet ON meet.lang = x.lang AND meet.source = x.source AND meet.item = y.source),
term AS (SELECT lang, a.source, 'term' AS part, term AS item, ({_GAP})::BIGINT AS value FROM dense a JOIN of_lang b USING (lang, term) WHERE a.n > 0 AND a.p > b.p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {SHOWN_TERMS}"""

ORACLES = {"op11_filter_audit": FILTER_AUDIT, "op12_term_divergence": DIVERGENCE, "op3_source_mixing": MIXING, "op5_url_filter": URLS, "op6_exact_top_k": TOP_K, "op10_warc_archives": WARC}
