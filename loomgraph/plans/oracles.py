"""SQL for the registered queries, in the dialect of DuckDB, over the same tables.

The common table expressions below build the canonical graph as plans.kg does.
"""

from __future__ import annotations

from ..functions.secrets import BLOB, PATTERNS
from ..operators.docs import GENERIC_HEADINGS
from ..operators.export import COLORS, FOOTER
from ..operators.metrics import CATEGORIES
from ..operators.report import ISOLATED, THIN
from ..schema import STRUCTURAL
from ..sources import files


def _in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _key(rank: int, key: str) -> str:
    return f"'{rank}:' || CASE WHEN length({key}::VARCHAR) < 12 THEN lpad({key}::VARCHAR, 12, '0') ELSE {key}::VARCHAR END"


def _nodes() -> str:
    own = lambda name: f"'tpch/{name}.py'"
    rows = [
        ("region", "region", "r_regionkey", "r_name", "code", own("region"), "r_regionkey", 1),
        ("nation", "nation", "n_nationkey", "n_name", "code", own("nation"), "n_regionkey", 2),
        ("customer", "customer", "c_custkey", "c_name", "code", own("customer"), "c_nationkey % 5", 3),
        ("supplier", "supplier", "s_suppkey", "s_name", "code", own("supplier"), "s_nationkey % 5", 4),
        ("part", "part", "p_partkey", "p_name", "code", own("part"), "5 + p_size % 5", 5),
        ("documents", "doc", "doc_id", "'doc-' || doc_id", "document", "source || '/doc_' || doc_id || '.md'", "10 + doc_id % 4", 6),
        ("page0", "page", "page_id", "h1", "paper", "host || '/page_' || page_id || '.pdf'", "14 + page_id % 3", 7),
        ("ent", "ent", "word", "word", "code", "'nav/' || left(word, 1) || '.py'", "17 + ascii(word) % 4", 8),
        ("embeddings", "img", "vec_id", "'vec-' || vec_id", "image", "'img/vec_' || vec_id || '.png'", "30 + label", 9),
    ]
    one = "SELECT '{1}:' || {2} AS id, {3} AS label, '{4}' AS file_type, {5} AS source_file, ({6})::INTEGER AS community, {8} AS ord FROM {0}"
    return "\nUNION ALL ".join(one.format(*r, _key(r[7], r[2])) for r in rows)


PAGE0 = "page0 AS (SELECT page_id, url, html, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1 FROM pages)"
ENTITIES = r"""
anchor AS (SELECT DISTINCT page_id, word FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) AS word FROM pages)
  WHERE regexp_matches(word, '^[a-z]{3,}$')),
ent AS (SELECT DISTINCT word FROM anchor),
mention AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
  WHERE word IN (SELECT word FROM ent))"""
NODES = f"{PAGE0},{ENTITIES},\nnodes AS ({_nodes()})"
EDGES = """
raw0 AS (
  SELECT 1 AS r, 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence FROM nation
  UNION ALL SELECT 2, 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'EXTRACTED' FROM customer
  UNION ALL SELECT 3, 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 4, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'uses', 'INFERRED' FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 5, 'page:' || page_id, 'ent:' || word, 'references', 'EXTRACTED' FROM anchor
  UNION ALL SELECT 6, 'doc:' || doc_id, 'ent:' || word, 'mentions', 'INFERRED' FROM mention
  UNION ALL SELECT 7, 'doc:' || f, 'doc:' || doc_id, 'same_concept', 'INFERRED' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents WHERE text IS NOT NULL) WHERE f <> doc_id
  UNION ALL SELECT 8, 'doc:' || doc_id, 'ent:' || min(word), 'related_to', 'AMBIGUOUS' FROM mention WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id
),
raw AS (SELECT *, r || ':' || source || ':' || target AS ord FROM raw0 WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
edges AS (SELECT least(source, target) AS a, greatest(source, target) AS b, arg_max(source, ord) AS src, arg_max(target, ord) AS tgt, arg_max(relation, ord) AS relation,
  arg_max(confidence, ord) AS confidence, min(ord) AS ord FROM raw GROUP BY 1, 2),
sides AS (SELECT a AS id, b AS other, src, tgt, relation, confidence, ord FROM edges UNION ALL SELECT b, a, src, tgt, relation, confidence, ord FROM edges WHERE a <> b),
deg AS (SELECT nodes.*, coalesce(n, 0)::BIGINT AS degree FROM nodes LEFT JOIN (SELECT id, sum(CASE WHEN id = other THEN 2 ELSE 1 END) AS n FROM sides GROUP BY id) USING (id)),
flag AS (SELECT *, coalesce(label <> '' AND ((source_file <> '' AND label = regexp_extract(source_file, '[^/]+$')) OR (ends_with(label, '()') AND (starts_with(label, '.') OR degree <= 1))), false) AS is_file,
  (coalesce(source_file, '') = '' OR NOT regexp_matches(regexp_extract(source_file, '[^/]+$'), '^.+\\.[^.]+$')) AS is_concept FROM deg),
lab AS (SELECT DISTINCT community, 'Group ' || community AS label FROM nodes)""".replace("\\\\", "\\")
GRAPH = f"{NODES},{EDGES}"
STATS = """
stats AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT community) FROM nodes) AS communities, count(*) AS edges,
  count(*) FILTER (WHERE confidence = 'EXTRACTED') AS e, count(*) FILTER (WHERE confidence = 'INFERRED') AS i, count(*) FILTER (WHERE confidence = 'AMBIGUOUS') AS m FROM edges)"""
PCT = "coalesce(round_even({0} * 100 / {1}, 0), 0)::BIGINT"
COHESION = """
coh AS (SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE round_even(coalesce(inside, 0) / (size * (size - 1) / 2), 2) END AS cohesion
  FROM (SELECT community, count(*) AS size FROM nodes GROUP BY 1) LEFT JOIN
  (SELECT x.community, count(*) AS inside FROM edges JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.community = y.community GROUP BY 1) USING (community))"""
LINKS = """
link AS (SELECT x.community, y.community AS other, count(*) AS edges FROM sides JOIN nodes x ON x.id = sides.id JOIN nodes y ON y.id = sides.other WHERE x.community <> y.community GROUP BY 1, 2)"""
BRIDGES = """
bridge AS (SELECT * FROM (SELECT d.community, d.id, d.degree, reach, row_number() OVER (PARTITION BY d.community ORDER BY reach DESC, d.degree DESC, d.id) AS rank
  FROM deg d JOIN (SELECT sides.id, count(DISTINCT y.community) AS reach FROM sides JOIN nodes x ON x.id = sides.id JOIN nodes y ON y.id = sides.other WHERE x.community <> y.community GROUP BY 1) r ON r.id = d.id) WHERE rank <= 5)"""
GODS = "gods AS (SELECT id, label, degree AS edges, community, source_file FROM flag WHERE NOT is_file AND NOT is_concept ORDER BY degree DESC, ord LIMIT 10)"


def _category(path: str) -> str:
    ext = f"lower(CASE WHEN contains({path}, '.') THEN split_part({path}, '.', -1) ELSE '' END)"
    return "CASE " + " ".join(f"WHEN {ext} IN {_in(v)} THEN '{k}'" for k, v in CATEGORIES.items()) + " ELSE 'doc' END"


def _is_test(path: str) -> str:
    return f"(starts_with(split_part({path}, '/', -1), 'test_') OR ends_with(split_part({path}, '/', -1), '_test.py') OR regexp_matches({path}, '(^|/)tests/'))"


SURPRISE = f"""
det AS (SELECT e.*, x.label AS la, y.label AS lb, x.source_file AS fa, y.source_file AS fb, x.community AS ca, y.community AS cb, x.degree AS da, y.degree AS db, x.ord AS oa, y.ord AS ob,
  x.is_file OR y.is_file AS any_file, x.is_concept OR y.is_concept AS any_concept FROM edges e JOIN flag x ON x.id = a JOIN flag y ON y.id = b),
uv AS (SELECT *, CASE WHEN oa > ob THEN lb ELSE la END AS lu, CASE WHEN oa > ob THEN la ELSE lb END AS lv, CASE WHEN oa > ob THEN fb ELSE fa END AS fu, CASE WHEN oa > ob THEN fa ELSE fb END AS fv,
  CASE WHEN oa > ob THEN db ELSE da END AS du, CASE WHEN oa > ob THEN da ELSE db END AS dv FROM det
  WHERE relation NOT IN {_in(STRUCTURAL)} AND NOT any_file AND NOT any_concept AND fa <> fb AND {_is_test("fa")} = {_is_test("fb")}),
kinds AS (SELECT *, {_category("fu")} AS ku, {_category("fv")} AS kv, split_part(fu, '/', 1) AS tu, split_part(fv, '/', 1) AS tv FROM uv),
surprise AS (SELECT *, (CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN ku <> kv THEN 2 ELSE 0 END + CASE WHEN tu <> tv THEN 2 ELSE 0 END
  + CASE WHEN ca <> cb THEN 1 ELSE 0 END + CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 1 ELSE 0 END)::INTEGER AS score,
  coalesce(nullif(concat_ws('; ', CASE WHEN confidence IN ('AMBIGUOUS', 'INFERRED') THEN lower(confidence) || ' connection - not explicitly stated in source' END,
  CASE WHEN ku <> kv THEN 'crosses file types (' || ku || ' ↔ ' || kv || ')' END, CASE WHEN tu <> tv THEN 'connects across different repos/directories' END,
  CASE WHEN ca <> cb THEN 'bridges separate communities' END,
  CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 'peripheral node `' || CASE WHEN du <= 2 THEN lu ELSE lv END || '` unexpectedly reaches hub `' || CASE WHEN du <= 2 THEN lv ELSE lu END || '`' END), ''),
  'cross-file semantic connection') AS why FROM kinds),
top AS (SELECT * FROM surprise ORDER BY score DESC, ord, a, b LIMIT 5),
crossed AS (SELECT CASE WHEN src = a THEN la ELSE lb END AS source, CASE WHEN src = a THEN lb ELSE la END AS target, CASE WHEN src = a THEN fa ELSE fb END AS from_file,
  CASE WHEN src = a THEN fb ELSE fa END AS to_file, confidence, relation, score, why FROM top)"""

WEB = """
web AS (SELECT page_id, html, (['', 'build/', 'src/my_env/', 'secrets/', 'docs/', 'node_modules/x/', 'conf/'])[(page_id % 7 + 1)::INT]
  || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '')
  || (['', '.py', '.pdf', '.md', '_token.txt', '.key', '.JPG', '/.env', '.tar.gz'])[(page_id % 9 + 1)::INT] AS path FROM pages),
name AS (SELECT *, regexp_extract(path, '[^/]+$') AS file, lower(regexp_extract(regexp_extract(path, '[^/]+$'), '^.+(\\.[^.]+)$', 1)) AS ext FROM web)""".replace("\\\\", "\\")
NOTE = """
note AS (SELECT doc_id, source, lang, source || '/doc_' || doc_id || '.md' AS source_file, CASE WHEN doc_id % 3 = 0
  THEN '**Doc ' || doc_id || '**\n\nintro\n\n**Ends with a stop.**\n\n**Part ' || source || '**\n\n'
  ELSE '# Doc ' || doc_id || '\n\n## Source ' || source || '\n\n### Deep ' || doc_id || '\n\n## Source ' || source || '\n\n# Other ' || doc_id || '\n\n## Overview\n\n' END
  || '- **Term ' || lang || '**: meaning\n* **x=y**: noise\n- **Doc ' || doc_id || '**: again\n\n[next](../src0/./doc_' || (doc_id + 1) || '.md#top) [web](https://example.com) ![img](pic.png) [next](../src0/doc_' || (doc_id + 1)
  || '.md)\n\nSee [[doc-' || doc_id || ']] and [[ghost-' || doc_id || '#a]].\n\n```\n# fenced\n[[InFence]]\n```\n\n[[ doc-' || (doc_id + 1) || ' ]]\n' || coalesce(text, '') AS text
  FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
line0 AS (SELECT doc_id, source_file, unnest(string_split(text, '\n')) AS line, unnest(range(1, len(string_split(text, '\n')) + 1)) AS line_no FROM note),
line1 AS (SELECT *, starts_with(trim(line), '```') AS fence, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY line_no) % 2 = 1 AS inside FROM line0),
line AS (SELECT * FROM line1 WHERE NOT fence AND NOT inside),
""".replace("\\n", "\n").replace("'\n'", "chr(10)")


def _noisy(t: str) -> str:
    return (
        rf"(length({t}) NOT BETWEEN 2 AND 40 OR regexp_matches({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f]') OR regexp_matches({t}, '  |\t') OR regexp_matches({t}, '[/\\={{}}()\[\]]') "
        rf"OR length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) < length({t}) * 0.5)"
    )


HEADING = rf"""
head0 AS (SELECT source_file, line_no, length(regexp_extract(line, '^(#{{1,4}})\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,4}})\s+(.+)$', 2)) AS title, trim(regexp_extract(line, '^\s*\*\*([^*]{{1,80}})\*\*\s*$', 1)) AS bold FROM line),
head1 AS (SELECT *, level > 0 AND NOT {_noisy("title")} AS is_real FROM head0),
head2 AS (SELECT *, bool_or(is_real) OVER (PARTITION BY source_file) AS has_real FROM head1),
heading AS (SELECT source_file, line_no, CASE WHEN is_real THEN level ELSE 1 END::INTEGER AS level, CASE WHEN is_real THEN title ELSE bold END AS heading FROM head2
  WHERE is_real OR (NOT has_real AND bold <> '' AND NOT regexp_matches(bold, '[.,:;?!]$')))"""
_ID = "substring(sha256({0} || '::' || {1}), 1, 12)"
_STEM = "regexp_replace(regexp_extract({0}, '[^/]+$'), '(.)\\.[^.]+$', '\\1')"
HUB = _ID.format("source_file", _STEM.format("source_file"))
SECTION = f"""
sec0 AS (SELECT *, {_ID.format("source_file", "heading")} AS id FROM heading WHERE level <= 2),
sec1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, id ORDER BY line_no) AS nth FROM sec0) WHERE nth = 1),
section AS (SELECT source_file, id, heading AS label, line_no, CASE WHEN level = 2 THEN coalesce(last_value(CASE WHEN level = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {HUB}) ELSE {HUB} END AS parent_id FROM sec1)"""
TERM = f"""
term AS (SELECT source_file, label, {_ID.format("source_file", "label")} AS id FROM (
  SELECT DISTINCT source_file, label FROM (SELECT source_file, 'Term ' || lang AS label FROM note UNION ALL SELECT source_file, 'Doc ' || doc_id FROM note) WHERE NOT {_noisy("label")}))"""
REF = f"""
ref0 AS (SELECT source_file, 'next' AS text, 'src0/doc_' || (doc_id + 1) || '.md' AS target FROM note UNION ALL SELECT source_file, 'img', source || '/pic.png' FROM note),
ref AS (SELECT *, {_ID.format("target", _STEM.format("target"))} AS target_id FROM ref0)"""


def _signs(text: str) -> str:
    parts = []
    for p in files.PAPER_SIGNS:
        flag = ", 'i'" if p.startswith("(?i)") else ""
        parts.append(f"regexp_matches({text}, {_text(p.removeprefix('(?i)'))}{flag})::INT")
    return " + ".join(parts)


def _sensitive() -> str:
    parts = []
    for p in files.SENSITIVE:
        flag = ", 'i'" if p.startswith("(?i)") else ""
        parts += [f"regexp_matches({c}, {_text(p.removeprefix('(?i)'))}{flag})" for c in ("path", "file")]
    return " OR ".join(parts)


WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''))"
STRIP_TAGS = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
TABLE_SAYS = r"role = 'user' AND length(text) >= 50 AND regexp_matches(text, '(^|[^\p{L}\p{N}_])(because|decided|with|from|para|und)([^\p{L}\p{N}_]|$)', 'i')"


def _secret(text: str, of: dict[str, str]) -> list[str]:
    out = []
    for name, p in of.items():
        flag = ", 'i'" if p.startswith("(?i)") else ""
        out.append(f"WHEN regexp_matches({text}, {_text(p.removeprefix('(?i)'))}{flag}) THEN '{name}'")
    return out


SECRET = f"CASE {' '.join(_secret('text', PATTERNS))} END"
HAS_SECRET = f"({SECRET} IS NOT NULL OR regexp_matches(text, {_text(BLOB)}))"
PYTHON = r"""
py AS (SELECT p_partkey AS k, p_partkey + 1 AS k1, p_name, p_brand, p_size, 'parts/part_' || p_partkey || '.py' AS source_file FROM part)"""
JAVA = r"""
java AS (SELECT s_suppkey AS k, s_name, s_nationkey AS n, 'java/Supplier' || s_suppkey || '.java' AS source_file FROM supplier)"""
TWO = "printf('%.2f', {0})"
NOTE_NAME = r"""
short AS (SELECT id, ord, CASE WHEN len(list_filter(regexp_split_to_array(label, '\s+'), lambda w: w <> '')) > 8 THEN regexp_replace(substr(label, 1, 60), '[ ,;:.-]+$', '') || '…' ELSE label END AS t FROM nodes),
clean0 AS (SELECT id, ord, replace(trim(regexp_replace(t, '[\\/*?:"<>|#^\[\]]', '', 'g')), '..', '') AS t FROM short),
clean AS (SELECT id, ord, CASE WHEN t = '' THEN 'unnamed' ELSE t END AS base FROM clean0),
named AS (SELECT id, CASE WHEN nth > 0 THEN base || '_' || nth ELSE base END AS file FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(base, '[…. ]+$', '') ORDER BY ord) - 1 AS nth FROM clean)),
dom AS (SELECT nodes.id, coalesce(c.confidence, 'EXTRACTED') AS confidence FROM nodes LEFT JOIN (SELECT id, confidence FROM (SELECT id, confidence, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(ord)) AS r
  FROM sides GROUP BY id, confidence) WHERE r = 1) c USING (id))"""
HYPEREDGES = """
of_order AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT 'part:' || l_partkey)) AS nodes FROM lineitem GROUP BY l_orderkey),
hyper AS (SELECT 'order:' || k AS id, 'Order ' || k AS label, nodes, 'participate_in' AS relation, 'INFERRED' AS confidence, (k % 100) / 100 AS confidence_score, '1:' || lpad(k::VARCHAR, 12, '0') AS ord FROM of_order
  UNION ALL SELECT 'pack:' || k, NULL, nodes, 'form', NULL, NULL, '3:' || lpad(k::VARCHAR, 12, '0') FROM of_order WHERE k % 7 = 0)"""
SHOPS = "shop AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS even, s_name, 'shop_' || s_suppkey AS id, 'shops/shop_' || s_suppkey || '.py' AS source_file FROM supplier)"
#: A name of a shop's module: words that hold the shop's number get it.
_OWN = "regexp_replace(regexp_replace({0}, '^_(till|base)', '_\\1' || k), '^_(helper|other)$', '_\\1_' || k)"
KIND = "coalesce(nullif(file_type, ''), 'other')"


def _graph(body: str, *more: str) -> str:
    return f"WITH {GRAPH}{''.join(',' + m for m in more)}\n{body}"


def _search(start: str) -> str:
    """Breadth-first search: each node once, with the smallest of its shortest paths."""
    return (
        f"bfs(id, hops, path) USING KEY (id) AS (SELECT '{start}', 0, ['{start}'] UNION SELECT link.other, min(bfs.hops) + 1, min(list_append(bfs.path, link.other)) "
        "FROM bfs JOIN link ON link.id = bfs.id LEFT JOIN recurring.bfs AS seen ON seen.id = link.other WHERE seen.id IS NULL GROUP BY link.other)"
    )


def _reached(body: str, *more: str) -> str:
    """SQL over a search of all links between two nodes."""
    return f"WITH RECURSIVE {GRAPH}, link AS MATERIALIZED (SELECT DISTINCT id, other FROM sides WHERE id <> other){''.join(',' + m for m in more)}\n{body}"


def _md5(x: str) -> str:
    return f"md5({x}) AS digest"


NL, NL2 = "chr(10)", "chr(10) || chr(10)"


ORACLES: dict[str, str] = {
    "a2_classify": f"WITH {WEB} SELECT ext, CASE WHEN ext IN {_in(files.CODE)} THEN 'code' WHEN ext IN {_in(files.PAPER)} THEN 'paper' WHEN ext IN {_in(files.IMAGE)} THEN 'image' WHEN ext IN {_in(files.DOCUMENT)} THEN CASE WHEN {_signs('substr(html, 1, 3000)')} >= 3 THEN 'paper' ELSE 'document' END WHEN ext IN {_in(files.OFFICE)} THEN 'document' ELSE 'none' END AS ftype, count(*) AS n FROM name GROUP BY 1, 2",
    "a3_noise_folders": f"WITH {WEB} SELECT page_id, len(list_filter(string_split(path, '/')[:-2], lambda p: p IN {_in(files.NOISE_DIRS)} OR ends_with(p, '_venv') OR ends_with(p, '_env') OR ends_with(p, '.egg-info'))) > 0 AS noise FROM web",
    "a4_paper_signs": f"SELECT doc_id, ({_signs('substr(text, 1, 3000)')})::INTEGER AS signs FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "a5_sensitive_paths": f"WITH {WEB} SELECT page_id, {_sensitive()} AS sensitive FROM name",
    "a6_ignored_paths": f"WITH {WEB} SELECT page_id, list_contains(string_split(path, '/'), 'conf') OR path LIKE '%.gz' OR regexp_matches(path, '^src/[^/]*_env/') OR regexp_matches(path, '^src/.*_env$') OR regexp_matches(path, '(^|/)m\\.') AS ignored FROM name",
    "a7_word_counts": f"SELECT doc_id, {WORDS}::INTEGER AS words FROM documents",
    "a8_corpus_warning": f"SELECT files, words, CASE WHEN words < 50000 THEN 'small' WHEN words >= 500000 OR files >= 200 THEN 'large' END AS warning FROM (SELECT count(*) AS files, sum({WORDS})::BIGINT AS words FROM documents)",
    "a13_html_text": f"SELECT page_id, length(t) AS length, {_md5('t')} FROM (SELECT page_id, {STRIP_TAGS.format('html')} AS t FROM pages)",
    "a15_sidecar_names": f"WITH {WEB} SELECT page_id, {_STEM.format('path')} || '_' || substr(sha256(path), 1, 8) || '.md' AS sidecar FROM web",
    "a17_ingested_pages": "SELECT url, file, length(text) AS length, md5('---' || chr(10) || 'source_url: \"' || url || '\"' || chr(10) || 'captured_at: \"1970-01-01T00:00:00+00:00\"' || chr(10) || '---' || chr(10) || chr(10) || text) AS digest FROM (SELECT url, regexp_replace(substr(regexp_replace(regexp_replace(url, 'https?://', '', 'g'), '[^\\p{L}\\p{N}_\\-.]', '_', 'g'), 1, 80), '_+$', '') || '.md' AS file, "
    + STRIP_TAGS.format(r"regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs')") + " AS text FROM pages)",
    "a18_url_guard": "SELECT page_id, NULL::VARCHAR AS blocked FROM pages UNION ALL SELECT page_id + 1000000000, (['scheme', 'private', 'host', 'private', 'scheme', 'private'])[(page_id % 6 + 1)::INT] FROM pages",
    "a19_notes": f"""SELECT conv_id, turn, 'note-20240506-070809-' || CASE WHEN slug = '' THEN 'note' ELSE slug END || '.md' AS file, CASE WHEN clean = '' THEN 'note text is empty' WHEN s IS NOT NULL THEN 'note holds a secret: ' || s ELSE '' END AS rejected,
  md5('---' || chr(10) || 'type: insight' || chr(10) || 'date: 2024-05-06T07:08:09' || chr(10) || 'tags: [' || role || ']' || chr(10) || 'links: [conv-' || conv_id || ']' || chr(10) || '---' || {NL2} || '# ' || heading || {NL2} || clean || {NL2} || '**Related:** [[conv-' || conv_id || ']]' || chr(10)) AS digest
  FROM (SELECT *, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug FROM
  (SELECT *, trim(substr(split_part(clean, chr(10), 1), 1, 80)) AS heading FROM (SELECT conv_id, turn, role, trim(coalesce(text, ''), chr(10) || chr(13) || chr(9) || ' ') AS clean, {SECRET} AS s FROM conversations)))""",
    "a20_graph_links": _graph("SELECT src AS source, tgt AS target, relation, confidence, CASE confidence WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END::DOUBLE AS confidence_score FROM edges"),
    "a21_vault_colors": _graph(f"SELECT community, 'tag:#community/Group_' || community AS query, ('0x' || substr(({list(COLORS)!r})[(community % 10 + 1)::INT], 2))::BIGINT AS rgb FROM lab"),
    "a22_node_notes": _graph(
        f"""SELECT n.id, {KIND.replace("file_type", "n.file_type")} AS folder, md5('---' || {NL} || 'source_file: "' || coalesce(n.source_file, '') || '"' || {NL} || 'type: "' || n.file_type || '"' || {NL} || 'community: "Group ' || n.community || '"' || {NL} || 'tags:' || {NL}
  || '  - wiki/' || n.file_type || {NL} || '  - wiki/' || dom.confidence || {NL} || '  - community/Group_' || n.community || {NL} || '---' || {NL2} || '# ' || n.label || {NL2}
  || CASE WHEN near IS NULL THEN '' ELSE '## Connections' || {NL} || near || {NL2} END || '#wiki/' || n.file_type || ' #wiki/' || dom.confidence || ' #community/Group_' || n.community) AS digest
  FROM nodes n JOIN dom USING (id) LEFT JOIN (SELECT sides.id, string_agg('- [[' || named.file || ']] - `' || relation || '` [' || confidence || ']', {NL} ORDER BY o.label, o.id) AS near FROM sides JOIN nodes o ON o.id = sides.other JOIN named ON named.id = sides.other GROUP BY 1) x ON x.id = n.id""",
        NOTE_NAME,
    ),
    "a23_note_files": _graph("SELECT id, file FROM named", NOTE_NAME),
    "a24_community_notes": _graph(
        f"""SELECT community, '_COMMUNITY_Group ' || community AS file, md5(concat_ws({NL}, '---' || {NL} || 'type: community' || {NL} || 'cohesion: ' || {TWO.format("cohesion")} || {NL} || 'members: ' || size || {NL} || '---' || {NL2} || '# Group ' || community || {NL},
  '**Cohesion:** ' || {TWO.format("cohesion")} || ' - ' || CASE WHEN cohesion >= 0.7 THEN 'tightly connected' WHEN cohesion >= 0.4 THEN 'moderately connected' ELSE 'loosely connected' END, '**Members:** ' || size || ' nodes' || {NL2} || '## Members', members || {NL},
  '## Live Query' || {NL2} || '```dataview' || {NL} || 'TABLE source_file, type FROM #community/Group_' || community || {NL} || 'SORT file.name ASC' || {NL} || '```' || {NL},
  CASE WHEN ties IS NOT NULL THEN '## Connections to other communities' || {NL} || ties || {NL} END, CASE WHEN tops IS NOT NULL THEN '## Top bridge nodes' || {NL} || tops || {NL} END)) AS digest
  FROM coh JOIN (SELECT community, string_agg('- [[' || file || ']]' || CASE WHEN coalesce(file_type, '') <> '' THEN ' - ' || file_type ELSE '' END || CASE WHEN coalesce(source_file, '') <> '' THEN ' - ' || source_file ELSE '' END, {NL} ORDER BY label, id) AS members FROM nodes JOIN named USING (id) GROUP BY 1) USING (community)
  LEFT JOIN (SELECT community, string_agg('- ' || edges || CASE WHEN edges = 1 THEN ' edge' ELSE ' edges' END || ' to [[_COMMUNITY_Group ' || other || ']]', {NL} ORDER BY -edges, other) AS ties FROM link GROUP BY 1) USING (community)
  LEFT JOIN (SELECT community, string_agg('- [[' || file || ']] - degree ' || degree || ', connects to ' || reach || CASE WHEN reach = 1 THEN ' community' ELSE ' communities' END, {NL} ORDER BY rank) AS tops FROM bridge JOIN named USING (id) GROUP BY 1) USING (community)""",
        NOTE_NAME, COHESION, LINKS, BRIDGES,
    ),
    "a25_vault_index": _graph(
        f"""SELECT 'head' AS section, 0 AS place, md5('---' || {NL} || 'type: vault-index' || {NL} || 'nodes: ' || n || {NL} || 'communities: ' || c || {NL} || '---' || {NL2} || '# Vault Index' || {NL2} || n || ' nodes across ' || c || ' communities.' || {NL}) AS digest FROM (SELECT count(*) AS n, count(DISTINCT community) AS c FROM nodes)
  UNION ALL SELECT kind, (row_number() OVER (ORDER BY n DESC, kind))::INTEGER, md5('## ' || upper(left(kind, 1)) || substr(kind, 2) || ' (' || n || ')' || {NL2} || entries || {NL}) FROM (SELECT {KIND} AS kind, count(*) AS n, string_agg('- [[' || file || ']] — degree ' || degree || CASE WHEN source_file <> '' THEN ' · `' || source_file || '`' ELSE '' END, {NL} ORDER BY lower(label), ord) AS entries FROM deg JOIN named USING (id) GROUP BY 1)
  UNION ALL SELECT 'communities', 1000000, md5('## Communities (' || count(*) || ')' || {NL2} || string_agg('- [[_COMMUNITY_Group ' || community || ']] — ' || size || ' members · cohesion ' || {TWO.format("cohesion")}, {NL} ORDER BY community) || {NL}) FROM coh""",
        NOTE_NAME, COHESION,
    ),
    "a26_wiki_articles": _graph(
        f"""SELECT community, md5(concat_ws({NL2}, '# Group ' || community, '> ' || size || ' nodes · cohesion ' || {TWO.format("cohesion")}, '## Key Concepts' || {NL2} || key || CASE WHEN size > 25 THEN {NL} || '- *... and ' || (size - 25) || ' more nodes in this community*' ELSE '' END,
  '## Relationships' || {NL2} || coalesce(crossed, '- No strong cross-community connections detected'), '## Source Files' || {NL2} || sources,
  '## Audit Trail' || {NL2} || {f" || {NL} || ".join(f"'- {k}: ' || coalesce({c}, 0) || ' (' || {PCT.format(f'coalesce({c}, 0)', 'nullif(total, 0)')} || '%)'" for k, c in (("EXTRACTED", "e"), ("INFERRED", "i"), ("AMBIGUOUS", "m")))}, {_text(FOOTER)})) AS digest
  FROM coh JOIN (SELECT community, string_agg('- **' || label || '** (' || degree || ' connections) — `' || source_file || '`', {NL} ORDER BY place) AS key FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS place FROM deg) WHERE place <= 25 GROUP BY 1) USING (community)
  LEFT JOIN (SELECT community, string_agg('- [[Group ' || other || ']] (' || edges || ' shared connections)', {NL} ORDER BY place) AS crossed FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY edges DESC, 'Group ' || other) AS place FROM link) WHERE place <= 12 GROUP BY 1) USING (community)
  LEFT JOIN (SELECT community, string_agg('- `' || source_file || '`', {NL} ORDER BY place) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY source_file) AS place FROM (SELECT DISTINCT community, source_file FROM nodes WHERE source_file <> '')) WHERE place <= 20 GROUP BY 1) USING (community)
  LEFT JOIN (SELECT community, count(*) FILTER (WHERE confidence = 'EXTRACTED') AS e, count(*) FILTER (WHERE confidence = 'INFERRED') AS i, count(*) FILTER (WHERE confidence = 'AMBIGUOUS') AS m, count(*) AS total FROM sides JOIN nodes USING (id) GROUP BY 1) USING (community)""",
        COHESION, LINKS,
    ),
    "a26_god_articles": _graph(
        f"""SELECT g.id, md5(concat_ws({NL2}, '# ' || g.label, '> God node · ' || g.edges || ' connections · `' || g.source_file || '`', '**Community:** [[Group ' || g.community || ']]', '## Connections by Relation' || {NL2} || groups, {_text(FOOTER)})) AS digest FROM gods g
  LEFT JOIN (SELECT id, string_agg('### ' || relation || {NL} || lines || {NL}, {NL} ORDER BY relation) AS groups FROM (SELECT id, relation, string_agg('- [[' || label || ']] `' || confidence || '`', {NL} ORDER BY place) AS lines FROM (
    SELECT s.id, s.relation, s.confidence, o.label, row_number() OVER (PARTITION BY s.id, s.relation ORDER BY o.degree DESC, o.id) AS place FROM sides s JOIN deg o ON o.id = s.other WHERE s.id IN (SELECT id FROM gods)) WHERE place <= 20 GROUP BY 1, 2) GROUP BY 1) x ON x.id = g.id""",
        GODS,
    ),
    "a27_chart_nodes": _graph(
        f"""SELECT id, replace(replace(replace(replace(replace(substr(regexp_replace(label, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS label, community, ({list(COLORS)!r})[(community % 10 + 1)::INT] AS color, degree,
  round_even(10 + 30 * degree / most, 1) AS size, CASE WHEN degree >= most * 0.15 THEN 12 ELSE 0 END AS font FROM (SELECT *, greatest(max(degree) OVER (), 1) AS most FROM (SELECT s.id, s.label, s.community, (SELECT count(*) FROM sides e WHERE e.id = s.id AND e.other IN (SELECT id FROM shown)) AS degree FROM shown s))""",
        """
best AS (SELECT id FROM deg ORDER BY degree DESC, ord LIMIT 200),
pick AS (SELECT id FROM best UNION SELECT other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, other) AS place FROM sides WHERE id IN (SELECT id FROM best)) WHERE place <= 3),
shown AS (SELECT * FROM nodes WHERE (SELECT count(*) FROM nodes) <= 5000 OR id IN (SELECT id FROM pick))""",
    ),
    "a28_ambiguous": _graph("SELECT '- `' || x.label || '` → `' || y.label || '`  [AMBIGUOUS]' || chr(10) || '   · relation: ' || relation AS line FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = tgt WHERE confidence = 'AMBIGUOUS'"),
    "a28_gaps": _graph(
        f"""SELECT 0::BIGINT AS place, '- **' || count(*) || ' isolated node(s):** ' || string_agg('`' || label || '`', ', ' ORDER BY ord, id) FILTER (WHERE r <= 5) || CASE WHEN count(*) > 5 THEN ' (+' || (count(*) - 5) || ' more)' ELSE '' END || chr(10) || '{ISOLATED}' AS line
  FROM (SELECT *, row_number() OVER (ORDER BY ord, id) AS r FROM flag WHERE degree <= 1 AND NOT is_file AND NOT is_concept) HAVING count(*) > 0
  UNION ALL SELECT community + 1, '- **Thin community `Group ' || community || '`** (' || count(*) || ' nodes): ' || string_agg('`' || label || '`', ', ' ORDER BY ord) || chr(10) || '{THIN}' FROM nodes WHERE community IS NOT NULL GROUP BY community HAVING count(*) < 3
  UNION ALL SELECT 1099511627776, '- **High ambiguity: ' || {PCT.format('m', 'edges')} || '% of edges are AMBIGUOUS.** Review the Ambiguous Edges section above.' FROM stats WHERE {PCT.format('m', 'edges')} > 20""",
        STATS,
    ),
    "a28_hyperedges": f"WITH {HYPEREDGES} SELECT row_number() OVER (ORDER BY ord, id) - 1 AS place, '- **' || coalesce(label, id) || '** — ' || array_to_string(nodes, ', ') || ' [' || coalesce(confidence, 'INFERRED') || CASE WHEN confidence_score IS NULL THEN '' ELSE ' ' || {TWO.format('confidence_score')} END || ']' AS line FROM hyper",
    "b_hyperedges": f"WITH {HYPEREDGES} SELECT id, label, array_to_string(nodes, ',') AS nodes, relation, confidence, confidence_score FROM hyper",
    "a20_hyperedge_json": f"WITH {HYPEREDGES} SELECT id, label, len(nodes)::INTEGER AS members, confidence_score, ord FROM hyper",
    "a29_activity_log": "SELECT event_id, '## [' || strftime(ts, '%Y-%m-%d %H:%M') || '] [' || event_type || '] | user ' || user_id AS line FROM events",
    "a30_safe_labels": r"""SELECT page_id, md5(replace(replace(replace(replace(replace(substr(regexp_replace(html, '[\x00-\x1f\x7f]', '', 'g'), 1, 256), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""",
    "b1_headings": f"WITH {NOTE}{HEADING} SELECT source_file, line_no, level, heading FROM heading",
    "b2_noisy_terms": f"SELECT doc_id, count(*) AS terms, count(*) FILTER (WHERE {_noisy('term')}) AS noisy FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\n|]')) AS term FROM documents)) GROUP BY 1",
    "b3_sections": f"WITH {NOTE}{HEADING},{SECTION} SELECT source_file, id, label, parent_id FROM section",
    "b4_definitions": f"WITH {NOTE}{TERM} SELECT source_file, id, label FROM term",
    "b5_links": f"WITH {NOTE}{REF} SELECT source_file, text, target, target_id FROM ref",
    "b6_page_links": f"WITH {PAGE0}, href AS (SELECT page_id, host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM page0) SELECT page_id, target, count(*) AS n FROM (SELECT page_id, CASE WHEN starts_with(href, '/') THEN concat_ws('/', host, nullif(array_to_string(list_filter(string_split(substr(split_part(href, '#', 1), 2), '/'), lambda p: p <> ''), '/'), '')) ELSE concat_ws('/', host, split_part(href, '#', 1)) END AS target FROM href) GROUP BY 1, 2",
    "b7_document_hubs": f"WITH {NOTE} x AS (SELECT 1) SELECT {HUB} AS id, {_STEM.format('source_file')} AS label, source_file, 'L1' AS source_location FROM note",
    "b8_without_fences": f"WITH {NOTE} x AS (SELECT 1) SELECT doc_id, length(t) AS length, {_md5('t')} FROM (SELECT doc_id, regexp_replace(text, '```.*?```', '', 'gs') AS t FROM note)",
    "b9_same_concept": f"WITH {NODES}, k AS (SELECT *, lower(trim(label)) AS key FROM nodes WHERE file_type IN ('paper', 'document')), h AS (SELECT key, arg_min(id, ord) AS hid, arg_min(source_file, ord) AS hf FROM k WHERE length(key) >= 3 AND key NOT IN {_in(GENERIC_HEADINGS)} GROUP BY 1) SELECT hid AS source, id AS target, 'same_concept' AS relation, 'INFERRED' AS confidence FROM k JOIN h USING (key) WHERE id <> hid AND source_file <> hf",
    "b10_cross_reference": f"""WITH {NODES}, e AS (SELECT name, arg_max(id, ord) AS id FROM (SELECT id, ord, lower(trim(label, '()')) AS name FROM nodes WHERE file_type = 'code' AND NOT starts_with(label, '.') AND label <> regexp_extract(source_file, '[^/]+$')) WHERE length(name) >= 3 GROUP BY 1),
  w AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS name FROM documents)),
  c AS (SELECT name, id, regexp_extract(name, '[\\p{{L}}\\p{{N}}_]+') AS first FROM e WHERE NOT regexp_full_match(name, '[\\p{{L}}\\p{{N}}_]+')),
  f AS (SELECT DISTINCT d.doc_id, c.id FROM w JOIN c ON w.name = c.first JOIN documents d USING (doc_id) WHERE contains(lower(d.text), c.name))
  SELECT 'doc:' || doc_id AS source, id AS target, 'mentions' AS relation, 'INFERRED' AS confidence FROM (SELECT doc_id, e.id FROM w JOIN e USING (name) WHERE regexp_full_match(name, '[\\p{{L}}\\p{{N}}_]+') UNION SELECT doc_id, id FROM f)""",
    "b11_image_hubs": "SELECT 'img_' || vec_id AS id, 'vec_' || vec_id AS label, 'image' AS file_type, 'img/vec_' || vec_id || '.png' AS source_file FROM embeddings",
    "c2_python_nodes": f"""WITH {PYTHON} SELECT 'part_' || k AS id, 'part_' || k || '.py' AS label, 'code' AS file_type, source_file, 1 AS line FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_1', left('Module of ' || p_name || ' with all its parts.', 80), 'rationale', source_file, 1 FROM py
  UNION ALL SELECT 'part_' || k || '_part' || k, 'Part' || k, 'code', source_file, 6 FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_7', 'Class of brand ' || p_brand || ' and type.', 'rationale', source_file, 7 FROM py
  UNION ALL SELECT 'part' || k1, 'Part' || k1, 'code', '', NULL FROM py
  UNION ALL SELECT 'part_' || k || '_part' || k || '_price', '.price()', 'code', source_file, 9 FROM py
  UNION ALL SELECT 'part_' || k || '_helper_' || k, 'helper_' || k || '()', 'code', source_file, 13 FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_14', '# NOTE: size ' || p_size, 'rationale', source_file, 14 FROM py""",
    "c8_python_edges": f"""WITH {PYTHON} SELECT 'part_' || k AS source, 'os' AS target, 'imports' AS relation, source_file, 2 AS line FROM py
  UNION ALL SELECT 'part_' || k, 'part_' || k1, 'imports_from', source_file, 3 FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_1', 'part_' || k, 'rationale_for', source_file, 1 FROM py
  UNION ALL SELECT 'part_' || k, 'part_' || k || '_part' || k, 'contains', source_file, 6 FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_7', 'part_' || k || '_part' || k, 'rationale_for', source_file, 7 FROM py
  UNION ALL SELECT 'part_' || k || '_part' || k, 'part' || k1, 'extends', source_file, 6 FROM py
  UNION ALL SELECT 'part_' || k || '_part' || k, 'part_' || k || '_part' || k || '_price', 'method', source_file, 9 FROM py
  UNION ALL SELECT 'part_' || k, 'part_' || k || '_helper_' || k, 'contains', source_file, 13 FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_14', 'part_' || k, 'rationale_for', source_file, 14 FROM py""",
    "c9_calls": f"WITH {PYTHON} SELECT 'part_' || k || '_part' || k || '_price' AS source, 'part_' || k || '_helper_' || k AS target, 'calls' AS relation, 'INFERRED' AS confidence, 10 AS line FROM py",
    "c11_signatures": f"WITH {PYTHON} SELECT 'part_' || k || '_part' || k || '_price' AS id, 'def price(self)' AS signature FROM py UNION ALL SELECT 'part_' || k || '_helper_' || k, 'def helper_' || k || '(x)' FROM py",
    "c12_reasons": f"""WITH {PYTHON} SELECT 'part_' || k || '_rationale_1' AS id, left('Module of ' || p_name || ' with all its parts.', 80) AS label, 1 AS line FROM py
  UNION ALL SELECT 'part_' || k || '_rationale_7', 'Class of brand ' || p_brand || ' and type.', 7 FROM py UNION ALL SELECT 'part_' || k || '_rationale_14', '# NOTE: size ' || p_size, 14 FROM py""",
    "c13_imported_classes": f"WITH {PYTHON} SELECT 'part_' || k || '_part' || k AS source, 'part_' || k1 || '_part' || k1 AS target, 3 AS line FROM py WHERE k1 IN (SELECT k FROM py)",
    "c2_branched_nodes": f"""WITH {SHOPS} SELECT id, 'shop_' || k || '.py' AS label, 'code' AS file_type, source_file, 1 AS line, NULL AS signature FROM shop
  UNION ALL SELECT id || '_rationale_1', 'Shop of ' || s_name || ' and others.', 'rationale', source_file, 1, NULL FROM shop
  UNION ALL SELECT id || '_till' || k, 'Till' || k, 'code', source_file, CASE WHEN even THEN 5 ELSE 11 END, NULL FROM shop
  UNION ALL SELECT id || '_helper_' || k, 'helper_' || k || '()', 'code', source_file, CASE WHEN even THEN 16 ELSE 15 END, 'def helper_' || k || '(x)' FROM shop
  UNION ALL SELECT id || '_till' || k || '_price', '.price()', 'code', source_file, 7, 'def price(self)' FROM shop WHERE even
  UNION ALL SELECT id || '_other_' || k, 'other_' || k || '()', 'code', source_file, 23, 'def other_' || k || '(x)' FROM shop WHERE even
  UNION ALL SELECT id || '_base' || k, 'Base' || k, 'code', source_file, 8, NULL FROM shop WHERE NOT even
  UNION ALL SELECT id || '_till' || k || '_load', '.load()', 'code', source_file, 12, 'async def load(self, n: int=1) -> list' FROM shop WHERE NOT even
  UNION ALL SELECT id || '_rationale_16', '# WHY: shop ' || k, 'rationale', source_file, 16, NULL FROM shop WHERE NOT even""",
    "c8_branched_edges": f"""WITH {SHOPS}, line(even, source, target, relation, line) AS (VALUES (true, '', 'os', 'imports', 2), (true, '', '@_till', 'contains', 5), (true, '_till', '@_till_price', 'method', 7), (true, '_till', '@_till_price', 'method', 11), (true, '', '@_helper', 'contains', 16),
  (true, '', '@_other', 'contains', 23), (true, '', '@_other', 'contains', 27), (true, '_rationale_1', '@', 'rationale_for', 1), (false, '_rationale_1', '@', 'rationale_for', 1), (false, '', 'json', 'imports', 3), (false, '', 'shop_0', 'imports_from', 5), (false, '', '@_base', 'contains', 8),
  (false, '', '@_till', 'contains', 11), (false, '_till', '@_base', 'extends', 11), (false, '_till', '@_till_load', 'method', 12), (false, '', '@_helper', 'contains', 15), (false, '_rationale_16', '@', 'rationale_for', 16))
  SELECT id || {_OWN.format('source')} AS source, CASE WHEN starts_with(target, '@') THEN id || {_OWN.format('substr(target, 2)')} ELSE target END AS target, relation, source_file, line FROM shop JOIN line USING (even)""",
    "c9_nested_calls": f"""WITH {SHOPS} SELECT id || '_till' || k || '_price' AS source, id || '_helper_' || k AS target, 'calls' AS relation, 'INFERRED' AS confidence, 12 AS line FROM shop WHERE even
  UNION ALL SELECT id || '_other_' || k, id || '_helper_' || k, 'calls', 'INFERRED', 28 FROM shop WHERE even
  UNION ALL SELECT id || '_till' || k || '_load', id || '_helper_' || k, 'calls', 'INFERRED', 13 FROM shop WHERE NOT even
  UNION ALL SELECT id || '_helper_' || k, id || '_till' || k, 'calls', 'INFERRED', 17 FROM shop WHERE NOT even""",
    "c3_declared_nodes": f"""WITH {JAVA} SELECT 'supplier' || k AS id, 'Supplier' || k || '.java' AS label, source_file, 'L1' AS source_location, NULL AS signature FROM java
  UNION ALL SELECT 'supplier' || k || '_supplier' || k, 'Supplier' || k, source_file, 'L7', NULL FROM java
  UNION ALL SELECT 'supplier' || k || '_supplier' || k || '_run', '.run()', source_file, 'L9', 'public void run()' FROM java
  UNION ALL SELECT 'nation' || n, 'Nation' || n, '', NULL, NULL FROM java UNION ALL SELECT 'runnable', 'Runnable', '', NULL, NULL FROM java""",
    "c10_inheritance": f"""WITH {JAVA} SELECT 'supplier' || k AS source, 'list' AS target, 'imports' AS relation, source_file, 'L1' AS source_location FROM java
  UNION ALL SELECT 'supplier' || k, 'supplier' || k || '_supplier' || k, 'contains', source_file, 'L7' FROM java
  UNION ALL SELECT 'supplier' || k || '_supplier' || k, 'supplier' || k || '_supplier' || k || '_run', 'method', source_file, 'L9' FROM java
  UNION ALL SELECT 'supplier' || k || '_supplier' || k, 'nation' || n, 'extends', source_file, 'L7' FROM java
  UNION ALL SELECT 'supplier' || k || '_supplier' || k, 'runnable', 'implements', source_file, 'L7' FROM java""",
    "c14_doc_comments": f"WITH {JAVA} SELECT source_file, 3 AS line, 'Supplier ' || s_name || ' of the schema.' AS text FROM java UNION ALL SELECT source_file, 8, 'Runs the supplier once a day.' FROM java",
    "c15_described_nodes": f"WITH {JAVA} SELECT 'supplier' || k || '_supplier' || k AS id, 'Supplier ' || s_name || ' of the schema.' AS description FROM java UNION ALL SELECT 'supplier' || k || '_supplier' || k || '_run', 'Runs the supplier once a day.' FROM java",
    "c_code_ids": r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace('_' || h, '^[_.]+|[_.]+$', '', 'g') || CASE WHEN rest = '' THEN '' ELSE '_' || regexp_replace(rest, '^[_.]+|[_.]+$', '', 'g') END, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS id FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS h, regexp_extract(url, '://[^/]*(.*)$', 1) AS rest FROM pages)",
    "d1_degrees": _graph("SELECT id, degree FROM deg"),
    "d2_god_nodes": _graph("SELECT id, label, edges FROM gods", GODS),
    "d3_stats": _graph(f"SELECT nodes, edges, communities, {PCT.format('e', 'edges')} AS extracted_pct, {PCT.format('i', 'edges')} AS inferred_pct, {PCT.format('m', 'edges')} AS ambiguous_pct FROM stats", STATS),
    "d4_inferred_score": _graph("SELECT count(*) AS inferred, round_even(avg(0.5), 2) AS avg_score FROM edges WHERE confidence = 'INFERRED'"),
    "d5_dominant_confidence": _graph("SELECT id, confidence FROM dom", NOTE_NAME),
    "d6_community_links": _graph("SELECT * FROM link", LINKS),
    "d7_bridges": _graph("SELECT community, rank::INTEGER AS rank, id, degree, reach FROM bridge", BRIDGES),
    "d8_links_by_label": _graph("SELECT link.community, lab.label, sum(edges)::BIGINT AS edges FROM link JOIN lab ON lab.community = link.other GROUP BY 1, 2", LINKS),
    "d9_surprise_scores": _graph("SELECT a, b, score, why FROM surprise", SURPRISE),
    "d10_cross_file": _graph("SELECT * FROM crossed", SURPRISE),
    "d11_cross_community": _graph(
        """SELECT low, high, CASE WHEN src = a THEN la ELSE lb END AS source, CASE WHEN src = a THEN lb ELSE la END AS target, confidence, relation FROM (
  SELECT *, least(ca, cb) AS low, greatest(ca, cb) AS high, row_number() OVER (PARTITION BY least(ca, cb), greatest(ca, cb) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, ord, a, b) AS place FROM det
  WHERE relation NOT IN """ + _in(STRUCTURAL) + " AND NOT any_file AND ca <> cb) WHERE place = 1", SURPRISE),
    "d12_surprising": _graph("SELECT source, target, from_file, to_file, confidence, relation, why AS note FROM crossed", SURPRISE),
    "d13_ambiguous": _graph("SELECT 'ambiguous_edge' AS type, 'What is the exact relationship between `' || CASE WHEN oa <= ob THEN la ELSE lb END || '` and `' || CASE WHEN oa <= ob THEN lb ELSE la END || '`?' AS question, 'Edge tagged AMBIGUOUS (relation: ' || relation || ') - confidence is low.' AS why FROM det WHERE confidence = 'AMBIGUOUS'", SURPRISE),
    "d13_unverified": _graph(
        """SELECT 'verify_inferred' AS type, 'Are the ' || n || ' inferred relationships involving `' || label || '` (e.g. with `' || met[1] || '` and `' || met[2] || '`) actually correct?' AS question, '`' || label || '` has ' || n || ' INFERRED edges - model-reasoned connections that need verification.' AS why
  FROM (SELECT t.id, t.label, count(*) AS n, list(o.label ORDER BY s.ord, o.ord) AS met FROM (SELECT * FROM flag WHERE NOT is_file ORDER BY degree DESC, ord LIMIT 5) t JOIN sides s ON s.id = t.id JOIN nodes o ON o.id = s.other WHERE s.confidence = 'INFERRED' GROUP BY 1, 2 HAVING count(*) >= 2)"""),
    "d14_isolated": _graph("SELECT id, label, degree FROM flag WHERE degree <= 1 AND NOT is_file AND NOT is_concept"),
    "d15_health": _graph(f"SELECT nodes, edges, communities, {PCT.format('e', 'edges')} AS extracted_pct, {PCT.format('i', 'edges')} AS inferred_pct, {PCT.format('m', 'edges')} AS ambiguous_pct, (SELECT count(*) FROM deg WHERE degree = 0) AS orphans, (SELECT count(*) FROM (SELECT community FROM nodes GROUP BY 1 HAVING count(*) <= 2)) AS tiny_communities, {PCT.format('m', 'edges')} > 10 AS high_ambiguity FROM stats", STATS),
    "d16_record_errors": _graph(
        f"""SELECT 'node' AS kind, CASE WHEN length(id) % 7 = 0 THEN 'missing file_type' ELSE 'invalid file_type note' END AS error, count(*) AS n FROM nodes WHERE length(id) % 7 <= 1 GROUP BY 2
  UNION ALL SELECT 'edge', 'invalid confidence SURE', count(*) FROM edges WHERE length(ord) % 5 = 1 HAVING count(*) > 0
  UNION ALL SELECT 'edge', 'target is no node: ' || tgt || '?', count(*) FROM edges WHERE length(ord) % 5 = 0 GROUP BY 2"""),
    "d17_first_labels": _graph("SELECT community, count(*) AS nodes, string_agg(label, ', ' ORDER BY place) FILTER (WHERE place <= 8) || CASE WHEN count(*) > 8 THEN ' (+' || (count(*) - 8) || ' more)' ELSE '' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS place FROM flag WHERE NOT is_file) GROUP BY 1"),
    "d18_inventory": _graph(f"SELECT {KIND} AS file_type, count(*) AS nodes FROM nodes GROUP BY 1"),
    "e4_cohesion": _graph("SELECT community, size, cohesion::DOUBLE AS cohesion FROM coh", COHESION),
    "e8_hops": _reached("SELECT id, hops, array_to_string(path, ' > ') AS path FROM bfs", _search("region:0")),
    "e8_components": _reached(
        "SELECT id, component FROM comp",
        "comp(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT link.id, min(comp.component) FROM comp JOIN link ON link.other = comp.id JOIN recurring.comp AS seen ON seen.id = link.id WHERE comp.component < seen.component GROUP BY link.id)",
    ),
    "f6_path": _reached(
        "SELECT (place - 1)::INTEGER AS hop, step.id, label, CASE WHEN place > 1 THEN relation END AS relation FROM step LEFT JOIN nodes ON nodes.id = step.id LEFT JOIN edges ON edges.a = least(step.id, step.before) AND edges.b = greatest(step.id, step.before)",
        _search("customer:0"),
        "step AS (SELECT place, path[place] AS id, path[place - 1] AS before FROM (SELECT path, unnest(range(1, len(path) + 1)) AS place FROM bfs WHERE id = 'supplier:1'))",
    ),
    "e9_induced": _graph("SELECT a, b, relation FROM edges WHERE a IN (SELECT id FROM nodes WHERE file_type = 'code') AND b IN (SELECT id FROM nodes WHERE file_type = 'code')"),
    "e10_neighbors": _graph("SELECT id, other, relation FROM sides"),
    "f1_find": f"WITH {NODES} SELECT id, label, CASE WHEN lower(label) = 'the' OR lower(id) = 'the' THEN 0 ELSE 1 END AS rank FROM nodes WHERE contains(lower(label), 'the') OR lower(id) = 'the'",
    "f2_search": f"WITH {NODES} SELECT id, label, source_file, score FROM (SELECT *, ({' + '.join(f'contains(lower(label), {t!r})::INT + contains(lower(source_file), {t!r})::INT * 0.5' for t in ('supplier', 'red', 'part', 'doc'))})::DOUBLE AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 15",
    "f3_node": _graph("SELECT id, label, file_type, source_file, degree FROM deg WHERE contains(lower(label), 'nation') OR lower(id) = 'nation' ORDER BY lower(label) <> 'nation' AND lower(id) <> 'nation', ord LIMIT 5"),
    "f4_neighbors": _graph("SELECT n.id, n.label, s.relation, s.confidence FROM sides s JOIN nodes n ON n.id = s.other WHERE s.id = (SELECT id FROM nodes WHERE contains(lower(label), 'the') OR lower(id) = 'the' ORDER BY lower(label) <> 'the' AND lower(id) <> 'the', ord LIMIT 1)"),
    "f5_community": _graph("SELECT id, label, source_file, degree FROM deg WHERE community = 2"),
    "f7_confidence": _graph("SELECT confidence, count(*) AS edges FROM edges GROUP BY 1"),
    "f9_orphans": _graph("SELECT id, label FROM deg WHERE degree = 0"),
    "f9_orphans_without_images": _graph("SELECT id, label FROM deg WHERE degree = 0 AND file_type <> 'image'"),
    "f10_stale_refs": f"WITH {NODES}, {NOTE} refs AS (SELECT source_file, line_no, trim(split_part(ref, '#', 1)) AS label FROM (SELECT source_file, line_no, unnest(regexp_extract_all(line, '\\[\\[([^\\]]+)\\]\\]', 1)) AS ref FROM line)) SELECT source_file, line_no, label FROM refs WHERE label <> '' AND label NOT IN (SELECT label FROM nodes)",
    "g2_candidates": f"SELECT conv_id, turn FROM conversations WHERE {TABLE_SAYS} AND NOT {HAS_SECRET}",
    "g3_secrets": f"SELECT doc_id, {SECRET} AS label, true AS secret FROM documents WHERE {HAS_SECRET}",
    "g5_tags": "SELECT conv_id, turn, (['decision', 'rationale', 'tradeoff', '', 'rationale'])[(turn % 5 + 1)::INT] AS tags FROM conversations WHERE text IS NOT NULL",
    "g6_flattened": "SELECT conv_id, turn, md5(text || ' ' || role) AS digest FROM conversations",
    "g7_pending": f"""SELECT conv_id, turn, md5('## [unknown] [conv' || conv_id || ']' || {NL} || 'Suggested note: ' || trim(substr(text, 1, 200), ' ' || chr(10)) || {NL} || 'Suggested links: (none)' || {NL} || 'Suggested tags: ' || coalesce(nullif(concat_ws(' ', CASE WHEN regexp_matches(text, '\\b(decided|decision|design choice)\\b', 'i') THEN '--tag decision' END,
  CASE WHEN regexp_matches(text, '\\b(rationale|because)\\b', 'i') THEN '--tag rationale' END, CASE WHEN regexp_matches(text, '\\b(trade-off|tradeoff)\\b', 'i') THEN '--tag tradeoff' END), ''), '(none)') || {NL} || 'Source excerpt: > ' || trim(replace(substr(text, 1, 300), chr(10), ' '))) AS digest FROM conversations WHERE {TABLE_SAYS} AND NOT {HAS_SECRET}""",
    "i1_content_keys": "SELECT doc_id, sha256(encode(text || chr(0) || source || '/doc_' || doc_id || '.md' || chr(0) || 'v2')) AS key FROM documents WHERE text IS NOT NULL",
    "i1_cache_misses": "WITH k AS (SELECT doc_id, source || '/doc_' || doc_id AS f, text FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM k WHERE doc_id % 3 = 0",
    "i3_changes": """WITH d AS (SELECT doc_id, source || '/doc_' || doc_id || '.md' AS path FROM documents) SELECT path, CASE WHEN doc_id % 2 = 1 THEN 'new' WHEN doc_id % 3 = 1 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 <> 1""",
    "i4_touched": "SELECT source || '/doc_' || doc_id || '.md' AS path FROM documents WHERE doc_id % 3 <> 1 AND (doc_id % 2 = 1 OR doc_id % 5 = 0)",
    "x_rollup": f"WITH {NODES} SELECT file_type, community, count(*) AS nodes, count(DISTINCT split_part(source_file, '/', 1)) AS tops FROM nodes GROUP BY ROLLUP (file_type, community)",
    "x_customer_orders": "SELECT o_orderkey, (row_number() OVER w)::INTEGER AS nth, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "x_unsold_parts": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity >= 48)",
    "x_event_hours": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, sum(floor(value * 100))::BIGINT AS cents FROM events GROUP BY 1, 2",
    "x_event_sliding": "SELECT start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY 1",
    "x_event_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
}
