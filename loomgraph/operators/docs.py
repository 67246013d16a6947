"""Markdown and plain text to nodes and edges: headings, sections, definitions, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import doc_id
from ..functions.text import is_noisy, lines, stem, without_fences

# Headings that say nothing about their subject and so link no documents.
GENERIC_HEADINGS = (
    "next steps", "troubleshooting", "examples", "overview", "summary", "getting started", "prerequisites", "installation", "usage", "faq",
    "best practices", "common issues", "see also", "references", "notes", "tips", "configuration", "setup", "introduction", "conclusion",
)
MAX_DEFINITIONS = 20
MIN_CONCEPT = 3


def numbered_lines(docs: DataFrame, key: str = "source_file", wanted: Column | None = None) -> DataFrame:
    """Lines outside fenced code: key, line_no (from 1), line. Fence marks themselves are left out. With `wanted` (of `line`) only such lines, and
    only these and the fence marks are shuffled."""
    split = docs.select(key, F.posexplode(lines(F.col("text"))).alias("at", "line"))
    fence = F.trim(F.col("line")).startswith("```")
    if wanted is not None:
        split = split.where(fence | wanted)
    before = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = split.withColumns({"fence": fence, "inside": F.sum(fence.cast("int")).over(before) % 2 == 1})
    return marked.where("not fence and not inside").select(key, (F.col("at") + 1).alias("line_no"), "line")


def headings(docs: DataFrame) -> DataFrame:
    """source_file, line_no, level, heading: `#` headings, or bold lines where a document has none of those."""
    found = numbered_lines(docs)
    hashed = F.regexp_extract("line", r"^(#{1,4})(?U:\s+)(.+)$", 1)
    title = F.trim(F.regexp_extract("line", r"^(#{1,4})(?U:\s+)(.+)$", 2))
    bold = F.trim(F.regexp_extract("line", r"^(?U:\s*)\*\*([^*\n]{1,80})\*\*(?U:\s*)$", 1))
    rows = found.withColumns({"hashes": hashed, "title": title, "bold": bold})
    real = (F.col("hashes") != "") & ~is_noisy(F.col("title"))
    rows = rows.withColumns({"real": real, "has_real": F.max(real).over(W.partitionBy("source_file"))})
    fallback = ~F.col("has_real") & (F.col("bold") != "") & ~F.col("bold").rlike("[.,:;?!]$")
    return rows.where(F.col("real") | fallback).select(
        "source_file", "line_no", F.when(F.col("real"), F.length("hashes")).otherwise(1).alias("level"), F.when(F.col("real"), F.col("title")).otherwise(F.col("bold")).alias("heading")
    )


def sections(docs: DataFrame) -> DataFrame:
    """The section tree: source_file, id, label, level, line_no, parent_id.

    Levels 1 and 2 only; of equal headings in a document the first stays. A level-2 section belongs to the last level-1
    section before it, every other to the document's hub.
    """
    kept = headings(docs).where("level <= 2").withColumn("id", doc_id(F.col("source_file"), F.col("heading")))
    first = W.partitionBy("source_file", "id").orderBy("line_no")
    kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    before = W.partitionBy("source_file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    above = F.last(F.when(F.col("level") == 1, F.col("id")), ignorenulls=True).over(before)
    hub = hub_id(F.col("source_file"))
    parent = F.when(F.col("level") == 2, F.coalesce(above, hub)).otherwise(hub)
    return kept.select("source_file", "id", F.col("heading").alias("label"), "level", "line_no", parent.alias("parent_id"))


def hub_id(source_file: Column) -> Column:
    """Id of the node that stands for a document."""
    return doc_id(source_file, stem(source_file))


def hubs(docs: DataFrame) -> DataFrame:
    """One node for each document."""
    return docs.select(hub_id(F.col("source_file")).alias("id"), stem(F.col("source_file")).alias("label"), "source_file", F.lit("L1").alias("source_location"))


def definitions(docs: DataFrame) -> DataFrame:
    """Terms of list items like `- **Term**: ...`: source_file, id, label, nth; the first 20 of a document, once each."""
    terms = F.regexp_extract_all(without_fences(F.col("text")), F.lit(r"(?md)^\s*[-*]\s+\*\*([^*]+)\*\*[:\s]"), F.lit(1))
    clean = F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: ~is_noisy(t))
    rows = docs.select("source_file", F.posexplode(F.array_distinct(F.slice(clean, 1, MAX_DEFINITIONS))).alias("nth", "label"))
    return rows.select("source_file", doc_id(F.col("source_file"), F.col("label")).alias("id"), "label", "nth")


def resolved_link(target: Column, source_file: Column) -> Column:
    """Path of a link's target from the corpus root; null for links elsewhere."""
    outside = target.rlike("^(https?://|#|mailto:)")
    bare = F.substring_index(target, "#", 1)
    folder = F.regexp_replace(source_file, "[^/]*$", "")
    path = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))

    def step(done: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~outside & (bare != "") & (F.size(parts) > 0), F.array_join(parts, "/"))


def links(docs: DataFrame) -> DataFrame:
    """Local links, once for each target: source_file, nth, text, target (path), target_id."""
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("target"))
    rows = docs.select("source_file", F.posexplode(pairs).alias("nth", "link")).select("source_file", "nth", F.col("link.text").alias("text"), resolved_link(F.col("link.target"), F.col("source_file")).alias("target"))
    first = W.partitionBy("source_file", "target").orderBy("nth")
    rows = rows.where("target is not null").withColumn("seen", F.row_number().over(first)).where("seen = 1")
    return rows.select("source_file", "nth", "text", "target", hub_id(F.col("target")).alias("target_id"))


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge records of documents (source_file, text, file_type)."""
    kinds = docs.select("source_file", "file_type")
    at = lambda step, nth: F.concat(F.col("source_file"), F.lit(f":{step}:"), F.lpad(nth.cast("string"), 8, "0"))
    node = ["id", "label", "file_type", "source_file", "source_location", "ord"]
    edge = ["source", "target", "relation", "confidence", "source_file", "source_location", "ord"]
    found = sections(docs).join(kinds, "source_file").withColumns({"source_location": F.concat(F.lit("L"), "line_no"), "ord": at(1, F.col("line_no"))})
    terms = definitions(docs).withColumns({"file_type": F.lit("document"), "source_location": F.lit(""), "ord": at(2, F.col("nth"))})
    refs = links(docs).withColumn("ord", at(3, F.col("nth")))
    nodes = hubs(docs).join(kinds, "source_file").withColumn("ord", at(0, F.lit(0))).select(node)
    nodes = nodes.unionByName(found.select(node)).unionByName(terms.select(node))
    nodes = nodes.unionByName(
        refs.select(F.col("target_id").alias("id"), stem(F.col("target")).alias("label"), F.lit("document").alias("file_type"), F.col("target").alias("source_file"), F.lit("").alias("source_location"), "ord")
    )
    hub, sure = hub_id(F.col("source_file")), F.lit("EXTRACTED").alias("confidence")
    edges = found.select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), sure, "source_file", "source_location", "ord")
    edges = edges.unionByName(terms.select(hub.alias("source"), F.col("id").alias("target"), F.lit("defines").alias("relation"), sure, "source_file", "source_location", "ord"))
    edges = edges.unionByName(refs.select(hub.alias("source"), F.col("target_id").alias("target"), F.lit("references").alias("relation"), sure, "source_file", F.lit("").alias("source_location"), "ord"))
    return nodes, edges.select(edge)


def same_concepts(nodes: DataFrame) -> DataFrame:
    """Edges from the first node with a label to those with the same label in other files: source, target, relation, confidence."""
    key = F.lower(F.trim("label"))
    rows = nodes.withColumn("key", key).where((F.length("key") >= MIN_CONCEPT) & ~F.col("key").isin(*GENERIC_HEADINGS))
    first = rows.groupBy("key").agg(F.min_by(F.struct("id", "source_file"), "ord").alias("head"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(first.select("key", "head"), "key").where("id <> head.id and source_file <> head.source_file")
    return pairs.select(F.col("head.id").alias("source"), F.col("id").alias("target"), F.lit("same_concept").alias("relation"), F.lit("INFERRED").alias("confidence"), "source_file", "ord")


def image_hubs(files: DataFrame) -> DataFrame:
    """Nodes of images, which have no edges: from files (source_file, place)."""
    return files.select(F.concat(F.lit("img_"), "place").alias("id"), stem(F.col("source_file")).alias("label"), F.lit("image").alias("file_type"), "source_file")
