"""Building the graph: records in order, later values over earlier ones.

A graph is a pair of DataFrames. `ord` orders records; of each attribute the last value that isn't null stays. A record's
place is that of its first appearance. Edges are undirected: all records between two nodes become one edge, which
keeps the direction of the last record that has one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(columns: list[str]) -> list[Column]:
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in columns]


def upsert_nodes(records: DataFrame) -> DataFrame:
    """One row for each id."""
    attributes = [c for c in records.columns if c not in ("id", "ord")]
    return records.groupBy("id").agg(*_last(attributes), F.min("ord").alias("ord"))


def upsert_edges(records: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row (a, b) for each unordered pair, a <= b, with the ends of the last record as src and tgt.

    Records with an end that is no node are dropped. Records may say `directed` = false to leave src and tgt alone. With nodes, records are
    shuffled twice, as they are: by b, and by a, where they meet both a's node and the other records of their pair.
    """
    if nodes is not None:
        records = records.where("source is not null and target is not null")
    directed = F.col("directed") if "directed" in records.columns else F.lit(True)
    attributes = [c for c in records.columns if c not in ("source", "target", "ord", "directed")]
    # 1 if the record leads from a to b, -1 if from b to a; null if it has no direction.
    way = F.when(directed, F.when(F.col("source") <= F.col("target"), 1).otherwise(-1))
    rows = records.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), way.alias("way"), *attributes, "ord")
    if nodes is not None:
        known = nodes.select("id")
        for end in ("b", "a"):
            rows = rows.join(known.withColumnRenamed("id", end), end, "left_semi")
    met = rows.groupBy("a", "b").agg(*_last(["way", *attributes]), F.min("ord").alias("ord"))
    ends = [F.when(F.col("way") == first, F.col("a")).when(F.col("way") == -first, F.col("b")).alias(name) for name, first in (("src", 1), ("tgt", -1))]
    return met.select("a", "b", *ends, *attributes, "ord")


def union_records(*parts: DataFrame) -> DataFrame:
    """Records of several extractions, one after the other."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("ord", F.concat(F.lit(f"{i:02d}:"), "ord"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_hyperedges(records: DataFrame) -> DataFrame:
    """Groups of nodes (id, nodes, ..., ord), one row for each id: the whole first record stays. Records without id are dropped."""
    rest = [c for c in records.columns if c != "id"]
    first = records.where("id is not null and id <> ''").groupBy("id").agg(F.min_by(F.struct(*rest), "ord").alias("first"))
    return first.select("id", *[F.col(f"first.{c}").alias(c) for c in rest])


@dataclass(frozen=True)
class Graph:
    """Nodes (id, label, file_type, source_file, community, ord, ...) and edges (a, b, src, tgt, relation, confidence, ord, ...), and groups of
    nodes (id, label, nodes, relation, confidence, confidence_score, source_file, ord) where something has said any."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        nodes = upsert_nodes(nodes)
        return cls(nodes, upsert_edges(edges, nodes))

    def with_hyperedges(self, records: DataFrame) -> Graph:
        """The graph with more hyperedges; of equal ids those it has stay, then the first."""
        had = self.hyperedges
        if had is not None:
            records = had.unionByName(records.join(had.select("id"), "id", "left_anti"), allowMissingColumns=True)
        return Graph(self.nodes, self.edges, first_hyperedges(records))

    @cached_property
    def sides(self) -> DataFrame:
        """Each edge from both of its ends: id, other and the edge's columns; a loop appears once."""
        rest = [c for c in self.edges.columns if c not in ("a", "b")]
        back = self.edges.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("other"), *rest)
        return self.edges.select(F.col("a").alias("id"), F.col("b").alias("other"), *rest).unionByName(back)

    @cached_property
    def degrees(self) -> DataFrame:
        """Nodes with their degree; a loop counts twice."""
        counts = self.sides.groupBy("id").agg(F.sum(F.when(F.col("id") == F.col("other"), 2).otherwise(1)).alias("degree"))
        return self.nodes.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph of the nodes in `ids`."""
        ids = ids.select("id").distinct()
        edges = self.edges
        for end in ("a", "b"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), edges.select(self.edges.columns), self.hyperedges)
