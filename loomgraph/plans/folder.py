"""From a folder to a graph with communities, and to its exports: the whole build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import extension
from ..operators import code, community, docs, export, questions, report, xref
from ..operators.build import Graph, union_records, upsert_edges, upsert_nodes
from ..operators.paths import cut
from ..sources import files, office
from ..streaming.watch import watch


def code_records(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge records of source files (source_file, text)."""
    python = cut(code.python_records(sources.where(extension(F.col("source_file")) == ".py")))
    at = lambda line: F.concat(F.lit("L"), line)
    place = F.concat("source_file", F.lit(":"), F.lpad(F.col("nth").cast("string"), 8, "0")).alias("ord")
    names = ["id", "label", "file_type", "source_file", "source_location", "signature", "ord"]
    nodes = python.where("kind = 'node'").select("id", "label", "file_type", "source_file", at(F.col("line")).alias("source_location"), "signature", place)
    more, links = code.declared_records(sources)
    nodes = nodes.unionByName(more.select(names))
    edge = ["source", "target", "relation", "confidence", "weight", "source_file", "source_location", "ord"]
    edges = python.where("kind = 'edge'").select("source", "target", "relation", "confidence", "weight", "source_file", at(F.col("line")).alias("source_location"), place)
    edges = edges.unionByName(links.select(edge))
    for found in (code.call_edges(python), code.imported_classes(python)):
        later = F.concat(F.lit("~"), "source_file", F.lit(":"), "source", F.lit(":"), "target").alias("ord")
        edges = edges.unionByName(found.select("source", "target", "relation", "confidence", "weight", "source_file", at(F.col("line")).alias("source_location"), later))
    said = code.described(nodes.where("source_location is not null"), code.doc_comments(sources)).withColumn("ord", F.lit("~"))
    return nodes.unionByName(said, allowMissingColumns=True), edges


def texts(found: DataFrame) -> DataFrame:
    """Documents (source_file, text, file_type): texts as they are, office formats converted."""
    plain = found.where("ftype in ('document', 'paper')").where(extension(F.col("source_file")).isin(*files.DOCUMENT)).select("source_file", "text", F.col("ftype").alias("file_type"))
    other = office.converted(found.where("ftype in ('document', 'paper')")).where("markdown <> ''")
    return plain.unionByName(other.select("source_file", F.col("markdown").alias("text"), F.col("ftype").alias("file_type")))


def build(spark: SparkSession, root: str, ignore: list[str] | None = None) -> Graph:
    """The graph of a folder: code, documents and images, cross-referenced, with communities."""
    found = cut(files.scan(spark, root, ignore).where("skipped is null").drop("path"))
    code_nodes, code_edges = code_records(found.where("ftype = 'code'").select("source_file", "text"))
    written = cut(texts(found))
    doc_nodes, doc_edges = docs.extract(written)
    numbered = found.where("ftype = 'image'").select("source_file", (F.row_number().over(W.orderBy("source_file")) - 1).alias("place"))
    images = docs.image_hubs(numbered).withColumn("ord", F.col("source_file"))
    nodes = cut(upsert_nodes(union_records(code_nodes, doc_nodes, images)))
    alike = docs.same_concepts(nodes.where("file_type in ('document', 'paper')"))
    named = xref.cross_reference(nodes, written.select("source_file", "text")).withColumn("ord", F.concat_ws("|", "source", "target"))
    edges = union_records(*[e.withColumn("directed", F.lit(True)) for e in (code_edges, doc_edges, alike)], named)
    graph = Graph(nodes, cut(upsert_edges(edges, nodes)))
    return Graph(cut(nodes.drop("community").join(community.cluster(graph), "id")), graph.edges)


def save(graph: Graph, path: str, title: str = "corpus", found: DataFrame | None = None) -> None:
    """The graph as JSON, its vault of notes, its wiki and its report, in folders below `path`. `found` is the corpus's scan."""
    labels = cut(community.labels(graph))
    export.write_json(graph, f"{path}/graph")
    export.write_vault(graph, labels, f"{path}/vault")
    export.write_wiki(graph, labels, f"{path}/wiki")
    total = None if found is None else files.warning(found)
    lines = cut(report.report(graph, labels, title, total, questions.suggest_questions(graph, labels)))
    lines.repartitionByRange(1, "section", "place").sortWithinPartitions("section", "place").select("line").write.text(f"{path}/report")


def keep_built(spark: SparkSession, root: str, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Watches a folder and, whenever files have changed, builds its graph anew and saves it to `path`/<number of the batch>."""

    def rebuilt(changes: DataFrame, batch: int) -> None:
        graph = build(spark, root)
        save(graph, f"{path}/{batch}-{uuid.uuid4().hex[:8]}", found=files.scan(spark, root))

    return watch(spark, root, rebuilt, checkpoint, available_now=available_now)
