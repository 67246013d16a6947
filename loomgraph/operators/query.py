"""Questions to a graph. Each returns a DataFrame; ties follow the nodes' order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WIKILINK
from .build import Graph
from .docs import numbered_lines


def find(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes by label or id, whatever the case: exact ones first (rank 0), then those whose label holds the term (1)."""
    t = term.lower()
    label = F.lower(F.coalesce("label", F.lit("")))
    exact = (label == t) | (F.lower("id") == t)
    return nodes.where(exact | F.contains(label, F.lit(t))).withColumn("rank", F.when(exact, 0).otherwise(1))


def first_match(nodes: DataFrame, term: str) -> DataFrame:
    return find(nodes, term).orderBy("rank", "ord").limit(1)


def search(nodes: DataFrame, text: str, top_n: int = 15) -> DataFrame:
    """Nodes by keywords of two characters or more: 1 for each in the label, 0.5 for each in the source file; ties: larger id."""
    terms = [t.lower() for t in text.split() if len(t) > 1]
    score = F.lit(0.0)
    for column, weight in (("label", 1.0), ("source_file", 0.5)):
        low = F.lower(F.coalesce(column, F.lit("")))
        for t in terms:
            score += F.when(F.contains(low, F.lit(t)), weight).otherwise(0.0)
    scored = nodes.withColumn("score", score).where("score > 0")
    return scored.orderBy(F.col("score").desc(), F.col("id").desc()).limit(top_n).select("id", "label", "source_file", "score")


def node(graph: Graph, term: str, shown: int = 5) -> DataFrame:
    """Details of the first matches, with degrees counted for those only."""
    found = find(graph.nodes, term).orderBy("rank", "ord").limit(shown)
    sides = graph.sides.join(found.select("id"), "id", "left_semi").groupBy("id").agg(F.sum(F.when(F.col("id") == F.col("other"), 2).otherwise(1)).alias("degree"))
    return found.join(sides, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def neighbors(graph: Graph, term: str) -> DataFrame:
    """Neighbours of the first match, by label: id, label, relation, confidence."""
    sides = graph.sides.join(first_match(graph.nodes, term).select("id"), "id", "left_semi")
    named = sides.select(F.col("other").alias("id"), "relation", "confidence").join(graph.nodes.select("id", "label"), "id")
    return named.select("id", "label", "relation", "confidence").orderBy("label", "id")


def community(graph: Graph, number: int) -> DataFrame:
    """Members of a community, by degree."""
    members = graph.degrees.where(F.col("community") == number)
    return members.orderBy(F.col("degree").desc(), "ord").select("id", "label", "source_file", "degree")


def orphans(graph: Graph, include_hubs: bool = False) -> DataFrame:
    """Nodes without edges; images only if asked for."""
    alone = graph.nodes.join(graph.sides.select("id"), "id", "left_anti")
    if not include_hubs:
        alone = alone.where("coalesce(file_type, '') <> 'image'")
    return alone.select("id", F.coalesce("label", "id").alias("label"))


def stale_refs(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """[[links]] of notes (source_file, text) that name no node: source_file, line_no, label."""
    refs = numbered_lines(notes, wanted=F.contains("line", F.lit("[["))).select("source_file", "line_no", F.explode(F.regexp_extract_all("line", F.lit(WIKILINK), F.lit(1))).alias("ref"))
    label = F.regexp_replace(F.substring_index("ref", "#", 1), r"(?U)^\s+|\s+$", "")
    refs = refs.select("source_file", "line_no", label.alias("label")).where("label <> ''")
    return refs.join(nodes.select(F.coalesce("label", "id").alias("label")), "label", "left_anti").select("source_file", "line_no", "label")
