"""Counts and rankings over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_name, has_suffix
from ..schema import CONFIDENCES, STRUCTURAL
from .build import Graph
from .paths import cut

# Suffixes by category of a source file; all others are documents.
CATEGORIES = {
    "code": ("py", "ts", "tsx", "js", "go", "rs", "java", "rb", "cpp", "c", "h", "cs", "kt", "scala", "php"),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "svg"),
}
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """Hubs of files and stubs of methods, which rankings leave out."""
    own = (F.coalesce(source_file, F.lit("")) != "") & (label == file_name(source_file))
    stub = label.endswith("()") & (label.startswith(".") | (degree <= 1))
    return F.coalesce((label != "") & (own | stub), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    """Nodes that no real file stands behind."""
    path = F.coalesce(source_file, F.lit(""))
    return (path == "") | ~has_suffix(path)


def flagged(graph: Graph) -> DataFrame:
    """Nodes with degree, is_file and is_concept."""
    return graph.degrees.withColumns({"is_file": is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), "is_concept": is_concept_node(F.col("source_file"))})


def god_nodes(graph: Graph, top_n: int = 10) -> DataFrame:
    """The most connected real nodes: id, label, edges."""
    real = flagged(graph).where("not is_file and not is_concept")
    return real.orderBy(F.col("degree").desc(), "ord").limit(top_n).select("id", F.coalesce("label", "id").alias("label"), F.col("degree").alias("edges"))


def confidence(column: Column | None = None) -> Column:
    return F.coalesce(column if column is not None else F.col("confidence"), F.lit("EXTRACTED"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves to even; of nothing 0."""
    return F.coalesce(F.bround(F.try_divide(part * 100, whole), 0), F.lit(0)).cast("long")


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, communities and the percent of edges of each confidence."""
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    counts = [F.count(F.when(confidence() == c, 1)).alias(c.lower()) for c in CONFIDENCES]
    edges = graph.edges.agg(F.count("*").alias("edges"), *counts)
    shares = [percent(F.col(c.lower()), F.col("edges")).alias(f"{c.lower()}_pct") for c in CONFIDENCES]
    return nodes.join(edges).select("nodes", "edges", "communities", *shares)  # a row and a row


def inferred_score(graph: Graph) -> DataFrame:
    """Number of inferred edges and their mean score (0.5 where unsaid), to two digits."""
    inferred = graph.edges.where(F.col("confidence") == "INFERRED")
    score = F.coalesce("confidence_score", F.lit(0.5)) if "confidence_score" in inferred.columns else F.lit(0.5)
    return inferred.agg(F.count("*").alias("inferred"), F.bround(F.avg(score), 2).alias("avg_score"))


def dominant_confidence(graph: Graph) -> DataFrame:
    """The commonest confidence of each node's edges (ties: that met first); EXTRACTED without edges."""
    counts = graph.sides.groupBy("id", confidence().alias("confidence")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("id").agg(F.min_by("confidence", F.struct(-F.col("n"), F.col("first"))).alias("confidence"))
    return graph.nodes.select("id").join(best, "id", "left").select("id", confidence().alias("confidence"))


def _ends(graph: Graph, *columns: str) -> DataFrame:
    """Edges with the communities (and other columns) of both ends, as community_a, community_b, ..."""
    out = graph.edges
    for end in ("a", "b"):
        out = out.join(graph.nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return out


def community_links(graph: Graph) -> DataFrame:
    """Edges between communities, counted from both: community, other, edges."""
    ends = _ends(graph, "community").where("community_a <> community_b")
    both = ends.select(F.col("community_a").alias("community"), F.col("community_b").alias("other")).unionByName(
        ends.select(F.col("community_b").alias("community"), F.col("community_a").alias("other"))
    )
    return both.groupBy("community", "other").agg(F.count("*").alias("edges"))


def community_reach(graph: Graph) -> DataFrame:
    """Nodes that touch other communities: id, community, degree, reach (distinct other communities)."""
    of = graph.nodes.select(F.col("id").alias("other"), F.col("community").alias("there"))
    own = graph.degrees.select("id", "community", "degree", "label", "ord")
    met = graph.sides.select("id", "other").join(of, "other").join(own, "id").where("there <> community")
    return met.groupBy("id", "community", "degree", "label", "ord").agg(F.countDistinct("there").alias("reach"))


def bridges(graph: Graph, top_n: int = 5) -> DataFrame:
    """Each community's nodes that reach most other communities: community, rank, id, degree, reach."""
    order = W.partitionBy("community").orderBy(F.col("reach").desc(), F.col("degree").desc(), "id")
    return community_reach(graph).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("community", "rank", "id", "degree", "reach")


def cohesion(graph: Graph) -> DataFrame:
    """Share of possible edges within each community, to two digits; 1 for single nodes: community, size, cohesion."""
    sizes = graph.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"))
    inside = _ends(graph, "community").where("community_a = community_b").groupBy(F.col("community_a").alias("community")).agg(F.count("*").alias("inside"))
    joined = sizes.join(inside, "community", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    share = F.bround(F.try_divide(F.col("inside"), F.col("size") * (F.col("size") - 1) / 2), 2)
    return joined.select("community", "size", F.when(F.col("size") <= 1, 1.0).otherwise(share).alias("cohesion"))


def category(path: Column) -> Column:
    suffix = F.lower(F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise(""))
    out = F.when(suffix.isin(*CATEGORIES["code"]), "code")
    for kind in ("paper", "image"):
        out = out.when(suffix.isin(*CATEGORIES[kind]), kind)
    return out.otherwise("doc")


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_test_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.startswith("test_") | name.endswith("_test.py") | path.rlike("(^|/)tests/")


def edge_details(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Edges, all or those given, with both ends' label, source_file, community, degree, flags and ord (suffixes _a and _b)."""
    nodes = flagged(graph).select("id", "label", "source_file", "community", "degree", "is_file", "is_concept", F.col("ord").alias("node_ord"))
    out = graph.edges if edges is None else edges
    for end in ("a", "b"):
        out = out.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in nodes.columns[1:]]), end)
    return out


def surprise(details: DataFrame) -> DataFrame:
    """Adds `score` and `why` to edges with their ends' details: how little one would expect them.

    Ends are taken in the graph's node order (u before v), as the reasons name them.
    """
    swap = F.col("node_ord_a") > F.col("node_ord_b")
    pick = lambda c, first: F.when(swap == F.lit(first), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    u, v = (lambda c: pick(c, True)), (lambda c: pick(c, False))
    conf = confidence()
    kinds = category(u("source_file")), category(v("source_file"))
    score = F.when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    score += F.when(kinds[0] != kinds[1], 2).otherwise(0)
    score += F.when(top_dir(u("source_file")) != top_dir(v("source_file")), 2).otherwise(0)
    apart = F.coalesce(u("community") != v("community"), F.lit(False))
    score += F.when(apart, 1).otherwise(0)
    alike = F.coalesce(F.col("relation") == "semantically_similar_to", F.lit(False))
    score = F.when(alike, F.floor(score * 1.5)).otherwise(score).cast("int")
    low, high = F.least(u("degree"), v("degree")), F.greatest(u("degree"), v("degree"))
    hub = (low <= 2) & (high >= 5)
    first_low = u("degree") <= 2
    names = [F.when(first_low, u("label")).otherwise(v("label")), F.when(first_low, v("label")).otherwise(u("label"))]
    reasons = F.array_compact(
        F.array(
            F.when(conf.isin("AMBIGUOUS", "INFERRED"), F.concat(F.lower(conf), F.lit(" connection - not explicitly stated in source"))),
            F.when(kinds[0] != kinds[1], F.concat(F.lit("crosses file types ("), kinds[0], F.lit(" ↔ "), kinds[1], F.lit(")"))),
            F.when(top_dir(u("source_file")) != top_dir(v("source_file")), F.lit("connects across different repos/directories")),
            F.when(apart, F.lit("bridges separate communities")),
            F.when(alike, F.lit("semantically similar concepts with no structural link")),
            F.when(hub, F.concat(F.lit("peripheral node `"), names[0], F.lit("` unexpectedly reaches hub `"), names[1], F.lit("`"))),
        )
    )
    why = F.array_join(reasons, "; ")
    return details.withColumns({"score": score + F.when(hub, 1).otherwise(0), "why": F.when(why == "", "cross-file semantic connection").otherwise(why)})


def _by_direction(details: DataFrame) -> DataFrame:
    """source and target labels and files in the direction of the last record."""
    forward = F.coalesce(F.col("src") == F.col("a"), F.lit(True))
    pick = lambda c, x, y: F.when(forward, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    return details.withColumns({"source": pick("label", "a", "b"), "target": pick("label", "b", "a"), "from_file": pick("source_file", "a", "b"), "to_file": pick("source_file", "b", "a")})


def cross_file_edges(graph: Graph) -> DataFrame:
    """Edges that may surprise: not structural, between real nodes of different files, tests apart from other code."""
    details = edge_details(graph).where(~F.coalesce("relation", F.lit("")).isin(*STRUCTURAL)).where("not (is_file_a or is_file_b or is_concept_a or is_concept_b)")
    differ = (F.col("source_file_a") != F.col("source_file_b")) & (is_test_path(F.col("source_file_a")) == is_test_path(F.col("source_file_b")))
    return surprise(details.where(differ))


def cross_file_surprises(graph: Graph, top_n: int = 5) -> DataFrame:
    order = [F.col("score").desc(), "ord", "a", "b"]
    # Scores first, then labels and reasons of those few edges: what all edges carry through the joins is short.
    best = cut(cross_file_edges(graph).select("a", "b", "score", "ord").orderBy(*order).limit(top_n).select("a", "b"))
    few = graph.edges.join(F.broadcast(best), ["a", "b"])
    return _by_direction(surprise(edge_details(graph, few)).orderBy(*order)).select("source", "target", "from_file", "to_file", confidence().alias("confidence"), "relation", "score", "why")


def cross_community_surprises(graph: Graph, top_n: int = 5) -> DataFrame:
    """One edge for each pair of communities, the least certain first."""
    details = edge_details(graph).where(~F.coalesce("relation", F.lit("")).isin(*STRUCTURAL)).where("not (is_file_a or is_file_b) and community_a <> community_b")
    rank = F.when(confidence() == "AMBIGUOUS", 0).when(confidence() == "INFERRED", 1).otherwise(2)
    pair = [F.least("community_a", "community_b").alias("low"), F.greatest("community_a", "community_b").alias("high")]
    best = details.withColumn("rank", rank).groupBy(*pair).agg(F.min_by(F.struct("a", "b"), F.struct("rank", "ord", "a", "b")).alias("edge"), F.min("rank").alias("rank"), F.min(F.struct("rank", "ord", "a", "b")).alias("at"))
    top = best.orderBy("at").limit(top_n).select("low", "high", F.col("edge.a").alias("a"), F.col("edge.b").alias("b"))
    return _by_direction(details.join(top, ["a", "b"])).select("low", "high", "source", "target", confidence().alias("confidence"), "relation")


def surprising_connections(graph: Graph, top_n: int = 5) -> DataFrame:
    """Surprises across files; across communities if there is one source file only, or nothing across files."""
    files = graph.nodes.where("source_file <> ''").select("source_file").distinct().limit(2).count()
    if files > 1:
        found = cut(cross_file_surprises(graph, top_n))
        if not found.isEmpty():
            return found.select("source", "target", "from_file", "to_file", "confidence", "relation", F.col("why").alias("note"))
    found = cross_community_surprises(graph, top_n)
    note = F.concat(F.lit("Bridges community "), F.col("low"), F.lit(" → community "), F.col("high"))
    return found.select("source", "target", F.lit(None).cast("string").alias("from_file"), F.lit(None).cast("string").alias("to_file"), "confidence", "relation", note.alias("note"))


def isolated(graph: Graph) -> DataFrame:
    """Real nodes with at most one edge."""
    return flagged(graph).where("degree <= 1 and not is_file and not is_concept").select("id", "label", "degree", "ord")


def health(graph: Graph, tiny: int = 2, ambiguity: int = 10) -> DataFrame:
    """One row of the health check: counts, orphans, tiny communities, confidence and whether ambiguity is high."""
    orphans = graph.degrees.agg(F.count(F.when(F.col("degree") == 0, 1)).alias("orphans"))
    small = graph.nodes.where("community is not null").groupBy("community").count().agg(F.count(F.when(F.col("count") <= tiny, 1)).alias("tiny_communities"))
    return stats(graph).join(orphans).join(small).withColumn("high_ambiguity", F.col("ambiguous_pct") > ambiguity)  # rows of one


def inventory(graph: Graph) -> DataFrame:
    """Nodes by type of file, without one as `other`."""
    kind = F.when(F.coalesce("file_type", F.lit("")) == "", "other").otherwise(F.col("file_type"))
    return graph.nodes.groupBy(kind.alias("file_type")).agg(F.count("*").alias("nodes"))


def first_labels(graph: Graph, shown: int = 8) -> DataFrame:
    """Each community's real nodes: the first labels by id, and how many more there are."""
    order = W.partitionBy("community").orderBy("id")
    real = flagged(graph).where("not is_file and community is not null").withColumn("place", F.row_number().over(order))
    head = F.sort_array(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "label"))))
    text = F.array_join(F.transform(head, lambda x: x["label"]), ", ")
    grouped = real.groupBy("community").agg(F.count("*").alias("nodes"), text.alias("shown"))
    more = F.when(F.col("nodes") > shown, F.concat(F.lit(" (+"), F.col("nodes") - shown, F.lit(" more)"))).otherwise("")
    return grouped.select("community", "nodes", F.concat("shown", more).alias("shown"))
