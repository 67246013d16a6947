"""One registered query for each operator, applied to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import ids, text
from ..functions.secrets import has_secret, secret_label
from ..functions.text import word_count
from ..operators import build, capture, centrality, code, community, docs, export, incremental, metrics, notes, paths, query, questions, report, validate, xref
from ..sources import files, office, web
from ..streaming import events as streams
from . import kg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def md5(c) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _labels(g: build.Graph) -> DataFrame:
    """Plain names of the canonical graph's communities."""
    return g.nodes.select("community").distinct().select("community", F.concat(F.lit("Group "), "community").alias("label"))


def _web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as pages' addresses name them, under folders of which some are noise, private or of a kind."""
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    folder = F.element_at(F.array(*map(F.lit, ("", "build/", "src/my_env/", "secrets/", "docs/", "node_modules/x/", "conf/"))), (F.col("page_id") % 7 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("", ".py", ".pdf", ".md", "_token.txt", ".key", ".JPG", "/.env", ".tar.gz"))), (F.col("page_id") % 9 + 1).cast("int"))
    return kg.table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.regexp_replace(url, "/$", ""), tail).alias("path"), "html")


# Scans, sources, sinks


@register
def a2_classify(spark, sf_dir):
    rows = _web_files(spark, sf_dir).select(text.extension(F.col("path")).alias("ext"), F.coalesce(files.classify(F.col("path"), F.col("html")), F.lit("none")).alias("ftype"))
    return rows.groupBy("ext", "ftype").agg(F.count("*").alias("n"))


@register
def a3_noise_folders(spark, sf_dir):
    return _web_files(spark, sf_dir).select("page_id", files.in_noise_dir(F.col("path")).alias("noise"))


@register
def a4_paper_signs(spark, sf_dir):
    return kg.table(spark, sf_dir, "documents").select("doc_id", files.paper_signs(F.col("text")).cast("int").alias("signs"))


@register
def a5_sensitive_paths(spark, sf_dir):
    return _web_files(spark, sf_dir).select("page_id", files.is_sensitive(F.col("path")).alias("sensitive"))


IGNORED = ["# comment", "", "/conf/", "*.gz", "src/*_env", "m.*"]


@register
def a6_ignored_paths(spark, sf_dir):
    return _web_files(spark, sf_dir).select("page_id", files.is_ignored(F.col("path"), IGNORED).alias("ignored"))


@register
def a7_word_counts(spark, sf_dir):
    return kg.table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@register
def a8_corpus_warning(spark, sf_dir):
    return files.warning(kg.table(spark, sf_dir, "documents").select(text.word_count(F.col("text")).alias("words")))


@register
def a13_html_text(spark, sf_dir):
    return kg.table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("length"), md5("t").alias("digest"))


@register
def a15_sidecar_names(spark, sf_dir):
    return _web_files(spark, sf_dir).select("page_id", office.sidecar(F.col("path")).alias("sidecar"))


@register
def a17_ingested_pages(spark, sf_dir):
    pages = kg.table(spark, sf_dir, "pages")
    return web.ingested(pages.select("url", "html")).select("url", "file", F.length("text").cast("long").alias("length"), md5("note").alias("digest"))


@register
def a18_url_guard(spark, sf_dir):
    pages = kg.table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.element_at(F.array(*map(F.lit, ("ftp://x.org/", "http://127.0.0.1/", "http://metadata.google.internal/", "https://10.1.2.3:80/", "file:///etc/", "http://[::1]/"))), (F.col("page_id") % 6 + 1).cast("int"))
    odd = pages.select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat(host, "url").alias("url"))
    return pages.unionByName(odd).select("page_id", web.guard(F.col("url")).alias("blocked"))


@register
def a19_notes(spark, sf_dir):
    rows = kg.messages(spark, sf_dir).withColumns(
        {"title": F.lit(None).cast("string"), "links": F.array(F.concat(F.lit("conv-"), "conv_id")), "tags": F.array(F.col("role")), "written": F.to_timestamp(F.lit("2024-05-06 07:08:09"))}
    )
    return notes.notes(rows).select("conv_id", "turn", "file", F.coalesce("rejected", F.lit("")).alias("rejected"), md5("content").alias("digest"))


@register
def a20_graph_links(spark, sf_dir):
    return export.confidence_scores(kg.graph(spark, sf_dir))


@register
def a20_graph_json(spark, sf_dir):
    rows = export.json_lines(kg.graph(spark, sf_dir))
    return rows.select("kind", md5("json").alias("digest"))


@register
def a22_node_notes(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return export.node_notes(g, _labels(g)).select("id", "folder", md5("note").alias("digest"))


@register
def a23_note_files(spark, sf_dir):
    return export.file_names(kg.graph(spark, sf_dir).nodes)


@register
def a24_community_notes(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return export.community_notes(g, _labels(g)).select("community", "file", md5("note").alias("digest"))


@register
def a25_vault_index(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return export.vault_index(g, _labels(g)).select("section", "place", md5("text").alias("digest"))


@register
def a21_vault_colors(spark, sf_dir):
    return export.color_groups(_labels(kg.graph(spark, sf_dir)))


@register
def a26_wiki_articles(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return export.wiki_articles(g, _labels(g)).select("community", md5("article").alias("digest"))


@register
def a26_god_articles(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return export.god_articles(g, _labels(g)).select("id", md5("article").alias("digest"))


@register
def a27_chart_nodes(spark, sf_dir):
    return export.chart_nodes(kg.graph(spark, sf_dir))


@register
def a28_report(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    total = files.warning(kg.documents(spark, sf_dir).select(word_count(F.col("text")).alias("words")))
    return report.report(g.with_hyperedges(kg.hyperedge_records(spark, sf_dir)), _labels(g), "corpus", total, questions.suggest_questions(g, _labels(g)))


@register
def a28_ambiguous(spark, sf_dir):
    return report.ambiguous(kg.graph(spark, sf_dir)).select("line")


@register
def a28_gaps(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return report.gaps(g, _labels(g)).select("place", "line")


@register
def a28_hyperedges(spark, sf_dir):
    return report.hyperedges(build.first_hyperedges(kg.hyperedge_records(spark, sf_dir))).select("place", "line")


@register
def b_hyperedges(spark, sf_dir):
    rows = build.first_hyperedges(kg.hyperedge_records(spark, sf_dir))
    return rows.select("id", "label", F.array_join("nodes", ",").alias("nodes"), "relation", "confidence", "confidence_score")


@register
def a20_hyperedge_json(spark, sf_dir):
    g = kg.graph(spark, sf_dir).with_hyperedges(kg.hyperedge_records(spark, sf_dir))
    back = export.json_lines(g).where("kind = 'hyperedge'").select(F.from_json("json", schema.HYPEREDGE).alias("h"))
    return back.select("h.id", "h.label", F.size("h.nodes").alias("members"), "h.confidence_score", "h.ord")


@register
def a29_activity_log(spark, sf_dir):
    rows = kg.table(spark, sf_dir, "events")
    return rows.select("event_id", notes.log_line(F.col("ts"), F.col("event_type"), F.concat(F.lit("user "), "user_id")).alias("line"))


@register
def a30_safe_labels(spark, sf_dir):
    return kg.table(spark, sf_dir, "pages").select("page_id", md5(text.sanitized(F.col("html"))).alias("digest"))


# Documents


@register
def b1_headings(spark, sf_dir):
    return docs.headings(kg.notes(spark, sf_dir)).select("source_file", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("int").alias("level"), "heading")


@register
def b2_noisy_terms(spark, sf_dir):
    terms = kg.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[\n|]"))).alias("term"))
    return terms.groupBy("doc_id").agg(F.count("*").alias("terms"), F.count(F.when(text.is_noisy(F.col("term")), 1)).alias("noisy"))


@register
def b3_sections(spark, sf_dir):
    return docs.sections(kg.notes(spark, sf_dir)).select("source_file", "id", "label", "parent_id")


@register
def b4_definitions(spark, sf_dir):
    return docs.definitions(kg.notes(spark, sf_dir)).select("source_file", "id", "label")


@register
def b5_links(spark, sf_dir):
    return docs.links(kg.notes(spark, sf_dir)).select("source_file", "text", "target", "target_id")


@register
def b6_page_links(spark, sf_dir):
    rows = kg.pages(spark, sf_dir).select("page_id", "host", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    shaped = F.concat(F.lit("../"), F.regexp_replace("href", "^/", "./a/../"), F.lit("#top"))
    return rows.select("page_id", docs.resolved_link(shaped, F.concat("host", F.lit("/deep/page.md"))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@register
def b7_document_hubs(spark, sf_dir):
    return docs.hubs(kg.notes(spark, sf_dir))


@register
def b8_without_fences(spark, sf_dir):
    return kg.notes(spark, sf_dir).select("doc_id", text.without_fences(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("length"), md5("t").alias("digest"))


@register
def b9_same_concept(spark, sf_dir):
    """Pages with one title, and parts with one name: labels that several files share."""
    nodes = kg.graph(spark, sf_dir).nodes.where("file_type in ('paper', 'document')")
    return docs.same_concepts(nodes).select("source", "target", "relation", "confidence")


@register
def b10_cross_reference(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return xref.cross_reference(g.nodes, kg.documents(spark, sf_dir).select("source_file", "text")).select("source", "target", "relation", "confidence")


@register
def b11_image_hubs(spark, sf_dir):
    images = kg.graph(spark, sf_dir).nodes.where("file_type = 'image'").select("source_file", F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("place"))
    return docs.image_hubs(images)


@register
def b_build_notes(spark, sf_dir):
    """The whole document stage: records of notes, built to a graph; edges with what stayed of them."""
    nodes, edges = docs.extract(kg.notes(spark, sf_dir))
    built = build.Graph.build(nodes, edges)
    return built.edges.select("a", "b", "src", "tgt", "relation")


@register
def b_built_note_nodes(spark, sf_dir):
    nodes, _ = docs.extract(kg.notes(spark, sf_dir))
    return build.upsert_nodes(nodes).select("id", "label", "file_type", "source_file", "source_location")


# Code


@register
def c2_python_nodes(spark, sf_dir):
    rows = code.python_records(kg.modules(spark, sf_dir)).where("kind = 'node'")
    return rows.select("id", "label", "file_type", "source_file", F.col("line").cast("int").alias("line"))


@register
def c8_python_edges(spark, sf_dir):
    rows = code.python_records(kg.modules(spark, sf_dir)).where("kind = 'edge'")
    return rows.select("source", "target", "relation", "source_file", F.col("line").cast("int").alias("line"))


@register
def c9_calls(spark, sf_dir):
    return code.call_edges(code.python_records(kg.modules(spark, sf_dir))).select("source", "target", "relation", "confidence", "line")


@register
def c11_signatures(spark, sf_dir):
    return code.python_records(kg.modules(spark, sf_dir)).where("signature is not null").select("id", "signature")


@register
def c12_reasons(spark, sf_dir):
    rows = code.python_records(kg.modules(spark, sf_dir)).where("file_type = 'rationale'")
    return rows.select("id", "label", F.col("line").cast("int").alias("line"))


@register
def c13_imported_classes(spark, sf_dir):
    return code.imported_classes(code.python_records(kg.modules(spark, sf_dir))).select("source", "target", "line")


@register
def c2_branched_nodes(spark, sf_dir):
    rows = code.python_records(kg.shops(spark, sf_dir)).where("kind = 'node'")
    return rows.select("id", "label", "file_type", "source_file", F.col("line").cast("int").alias("line"), "signature")


@register
def c8_branched_edges(spark, sf_dir):
    rows = code.python_records(kg.shops(spark, sf_dir)).where("kind = 'edge'")
    return rows.select("source", "target", "relation", "source_file", F.col("line").cast("int").alias("line"))


@register
def c9_nested_calls(spark, sf_dir):
    return code.call_edges(code.python_records(kg.shops(spark, sf_dir))).select("source", "target", "relation", "confidence", "line")


@register
def c3_declared_nodes(spark, sf_dir):
    nodes, _ = code.declared_records(kg.headers(spark, sf_dir))
    return nodes.select("id", "label", "source_file", "source_location", "signature")


@register
def c10_inheritance(spark, sf_dir):
    _, edges = code.declared_records(kg.headers(spark, sf_dir))
    return edges.select("source", "target", "relation", "source_file", "source_location")


@register
def c14_doc_comments(spark, sf_dir):
    return code.doc_comments(kg.headers(spark, sf_dir)).select("source_file", F.col("line").cast("int").alias("line"), "text")


@register
def c15_described_nodes(spark, sf_dir):
    files_ = kg.headers(spark, sf_dir)
    nodes, _ = code.declared_records(files_)
    return code.described(nodes.where("source_location <> 'L1'"), code.doc_comments(files_))


@register
def c_code_ids(spark, sf_dir):
    rows = kg.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "://[^/]*(.*)$", 1).alias("rest"))
    return rows.select("page_id", ids.code_id(F.concat(F.lit("_"), "host"), F.lit(""), "rest").alias("id"))


# Counts and rankings


@register
def d1_degrees(spark, sf_dir):
    return kg.graph(spark, sf_dir).degrees.select("id", "degree")


@register
def d2_god_nodes(spark, sf_dir):
    return metrics.god_nodes(kg.graph(spark, sf_dir))


@register
def d3_stats(spark, sf_dir):
    return metrics.stats(kg.graph(spark, sf_dir))


@register
def d4_inferred_score(spark, sf_dir):
    return metrics.inferred_score(kg.graph(spark, sf_dir))


@register
def d5_dominant_confidence(spark, sf_dir):
    return metrics.dominant_confidence(kg.graph(spark, sf_dir))


@register
def d6_community_links(spark, sf_dir):
    return metrics.community_links(kg.graph(spark, sf_dir))


@register
def d7_bridges(spark, sf_dir):
    return metrics.bridges(kg.graph(spark, sf_dir))


@register
def d8_links_by_label(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    other = _labels(g).select(F.col("community").alias("other"), "label")
    return metrics.community_links(g).join(other, "other").groupBy("community", "label").agg(F.sum("edges").alias("edges"))


@register
def d9_surprise_scores(spark, sf_dir):
    rows = metrics.cross_file_edges(kg.graph(spark, sf_dir))
    return rows.select("a", "b", F.col("score").cast("int").alias("score"), "why")


@register
def d10_cross_file(spark, sf_dir):
    return metrics.cross_file_surprises(kg.graph(spark, sf_dir)).withColumn("score", F.col("score").cast("int"))


@register
def d11_cross_community(spark, sf_dir):
    return metrics.cross_community_surprises(kg.graph(spark, sf_dir), top_n=1_000)


@register
def d12_surprising(spark, sf_dir):
    return metrics.surprising_connections(kg.graph(spark, sf_dir))


@register
def d13_questions(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return questions.suggest_questions(g, _labels(g))


@register
def d13_unverified(spark, sf_dir):
    return questions.unverified(kg.graph(spark, sf_dir)).select("type", "question", "why")


@register
def d13_ambiguous(spark, sf_dir):
    return questions.ambiguous(kg.graph(spark, sf_dir)).select("type", "question", "why")


@register
def d14_isolated(spark, sf_dir):
    return metrics.isolated(kg.graph(spark, sf_dir)).select("id", "label", "degree")


@register
def d15_health(spark, sf_dir):
    return metrics.health(kg.graph(spark, sf_dir))


@register
def d16_record_errors(spark, sf_dir):
    """Errors of doctored records: each seventh node without a type of file, each fifth edge with an end that is no node."""
    g = kg.graph(spark, sf_dir)
    nodes = g.nodes.withColumn("file_type", F.when(F.length("id") % 7 == 0, F.lit(None)).when(F.length("id") % 7 == 1, "note").otherwise(F.col("file_type")))
    edges = g.edges.select("src", "tgt", "relation", "confidence", "ord").withColumns(
        {"source": F.col("src"), "target": F.when(F.length("ord") % 5 == 0, F.concat("tgt", F.lit("?"))).otherwise(F.col("tgt")), "source_file": F.lit("x"), "confidence": F.when(F.length("ord") % 5 == 1, "SURE").otherwise(F.col("confidence"))}
    )
    return validate.record_errors(nodes, edges).groupBy("kind", "error").agg(F.count("*").alias("n"))


@register
def d17_first_labels(spark, sf_dir):
    return metrics.first_labels(kg.graph(spark, sf_dir))


@register
def d18_inventory(spark, sf_dir):
    return metrics.inventory(kg.graph(spark, sf_dir))


# Graph algorithms


@register
def e1_communities(spark, sf_dir):
    return community.cluster(kg.graph(spark, sf_dir))


@register
def e4_cohesion(spark, sf_dir):
    return metrics.cohesion(kg.graph(spark, sf_dir))


@register
def e5_labels(spark, sf_dir):
    return community.labels(kg.graph(spark, sf_dir))


@register
def e6_betweenness(spark, sf_dir):
    return centrality.betweenness(kg.graph(spark, sf_dir), edges=False)[0]


@register
def e7_edge_betweenness(spark, sf_dir):
    return centrality.betweenness(kg.graph(spark, sf_dir))[1]


@register
def e8_hops(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return paths.reached(g, g.nodes.where("id = 'region:0'").select("id")).select("id", "hops", F.array_join("path", " > ").alias("path"))


@register
def e8_components(spark, sf_dir):
    return paths.components(kg.graph(spark, sf_dir))


@register
def e9_induced(spark, sf_dir):
    g = kg.graph(spark, sf_dir)
    return g.induced(g.nodes.where("file_type = 'code'").select("id")).edges.select("a", "b", "relation")


@register
def e10_neighbors(spark, sf_dir):
    return kg.graph(spark, sf_dir).sides.select("id", "other", "relation")


# Questions


@register
def f1_find(spark, sf_dir):
    return query.find(kg.graph(spark, sf_dir).nodes, "The").select("id", "label", "rank")


@register
def f2_search(spark, sf_dir):
    return query.search(kg.graph(spark, sf_dir).nodes, "supplier red part a doc")


@register
def f3_node(spark, sf_dir):
    return query.node(kg.graph(spark, sf_dir), "nation").select("id", "label", "file_type", "source_file", "degree")


@register
def f4_neighbors(spark, sf_dir):
    return query.neighbors(kg.graph(spark, sf_dir), "the")


@register
def f5_community(spark, sf_dir):
    return query.community(kg.graph(spark, sf_dir), 2)


@register
def f6_path(spark, sf_dir):
    return paths.shortest_path(kg.graph(spark, sf_dir), "customer:0", "supplier:1").withColumn("hop", F.col("hop").cast("int"))


@register
def f7_confidence(spark, sf_dir):
    return kg.graph(spark, sf_dir).edges.groupBy("confidence").agg(F.count("*").alias("edges"))


@register
def f9_orphans(spark, sf_dir):
    return query.orphans(kg.graph(spark, sf_dir), include_hubs=True)


@register
def f9_orphans_without_images(spark, sf_dir):
    return query.orphans(kg.graph(spark, sf_dir))


@register
def f10_stale_refs(spark, sf_dir):
    rows = query.stale_refs(kg.graph(spark, sf_dir).nodes, kg.notes(spark, sf_dir).select("source_file", "text"))
    return rows.select("source_file", F.col("line_no").cast("long").alias("line_no"), "label")


# Session logs

#: The default keywords say nothing in the tables' invented languages; these do.
TABLE_KEYWORDS = ("because", "decided", "with", "from", "para", "und")


@register
def g2_candidates(spark, sf_dir):
    return capture.candidates(kg.messages(spark, sf_dir), TABLE_KEYWORDS).select("conv_id", "turn")


@register
def g3_secrets(spark, sf_dir):
    rows = kg.table(spark, sf_dir, "documents").select("doc_id", secret_label(F.col("text")).alias("label"), has_secret(F.col("text")).alias("secret"))
    return rows.where("secret")


@register
def g4_links(spark, sf_dir):
    said = kg.messages(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.concat(F.lit("see [[conv-"), "conv_id", F.lit("]] "), "text").alias("text"))
    labels = kg.graph(spark, sf_dir).nodes.where("file_type = 'code'").select("label")
    return capture.links(said, labels, "message").select("message", F.array_join("links", "|").alias("links"))


@register
def g5_tags(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("We decided: ", "The rationale: ", "A trade-off: ", "", "Because: "))), (F.col("turn") % 5 + 1).cast("int"))
    return kg.messages(spark, sf_dir).select("conv_id", "turn", F.array_join(capture.tags(F.concat(said, "text")), ",").alias("tags"))


@register
def g6_flattened(spark, sf_dir):
    rows = kg.messages(spark, sf_dir).select("conv_id", "turn", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))).alias("content"))
    return rows.select("conv_id", "turn", md5(capture.flattened(F.col("content"))).alias("digest"))


@register
def g7_pending(spark, sf_dir):
    rows = capture.candidates(kg.messages(spark, sf_dir), TABLE_KEYWORDS).withColumns(
        {"ts": F.lit(None).cast("string"), "session": F.concat(F.lit("conv"), "conv_id"), "links": F.array().cast("array<string>"), "tags": capture.tags(F.col("text"))}
    )
    return capture.pending(rows).select("conv_id", "turn", md5("entry").alias("digest"))


# Incremental work


@register
def i1_content_keys(spark, sf_dir):
    return kg.documents(spark, sf_dir).where("text is not null").select("doc_id", incremental.content_key(F.col("text"), F.col("source_file")).alias("key"))


@register
def i1_cache_misses(spark, sf_dir):
    rows = kg.documents(spark, sf_dir).where("text is not null").select("doc_id", incremental.content_key(F.col("text"), F.col("source_file")).alias("key"))
    return incremental.misses(rows, rows.where("doc_id % 3 <> 0")).select("doc_id")


def _manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = kg.documents(spark, sf_dir).select("doc_id", F.col("source_file").alias("path"), F.length("text").alias("mtime"))
    after = rows.where("doc_id % 3 <> 1").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    return rows.where("doc_id % 2 = 0").select("path", "mtime"), after


@register
def i3_changes(spark, sf_dir):
    return incremental.changes(*_manifests(spark, sf_dir))


@register
def i4_touched(spark, sf_dir):
    return incremental.touched(*_manifests(spark, sf_dir))


# Extensions beyond the reference: relational features on the graph and windows over events


@register
def x_rollup(spark, sf_dir):
    rows = kg.graph(spark, sf_dir).nodes.withColumn("top", metrics.top_dir(F.col("source_file")))
    return rows.rollup("file_type", "community").agg(F.count("*").alias("nodes"), F.countDistinct("top").alias("tops"))


@register
def x_customer_orders(spark, sf_dir):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = kg.table(spark, sf_dir, "orders").withColumns({"nth": F.row_number().over(order), "days": F.datediff("o_orderdate", F.lag("o_orderdate").over(order))})
    return rows.select("o_orderkey", F.col("nth").cast("int").alias("nth"), F.col("days").cast("long").alias("days"))


@register
def x_unsold_parts(spark, sf_dir):
    """Parts that were never sold in large quantities."""
    sold = kg.table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return kg.table(spark, sf_dir, "part").join(sold, "p_partkey", "left_anti").select("p_partkey")


@register
def x_event_hours(spark, sf_dir):
    return streams.tumbling(kg.table(spark, sf_dir, "events"))


@register
def x_event_sliding(spark, sf_dir):
    return streams.sliding(kg.table(spark, sf_dir, "events"))


@register
def x_event_sessions(spark, sf_dir):
    return streams.sessions(kg.table(spark, sf_dir, "events"))
