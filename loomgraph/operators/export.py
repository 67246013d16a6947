"""Exports: a graph's rows as JSON, notes, articles, reports and chart data. Each text is a column; Spark's writers make the files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import sanitized, truncated_label, vault_name
from . import metrics
from .build import Graph

# Colours of communities, and the size from which charts show a part only.
COLORS = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")
MAX_CHART_NODES, CHART_TOP, CHART_NEIGHBORS = 5_000, 200, 3
FOOTER = "---\n\n*Part of the knowledge wiki. See [[index]] to navigate.*"


def two_digits(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _joined(sort: list, text: Column, sep: str = "\n") -> Column:
    """Texts of a group in a given order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sort)], text.alias("text"))))
    return F.array_join(F.transform(rows, lambda x: x["text"]), sep)


def _score(edges: DataFrame) -> Column:
    score = F.coalesce(*[F.when(metrics.confidence() == k, v) for k, v in metrics.CONFIDENCE_SCORES.items()], F.lit(1.0))
    return F.coalesce("confidence_score", score) if "confidence_score" in edges.columns else score


def _ends() -> list[Column]:
    return [F.coalesce("src", "a").alias("source"), F.coalesce("tgt", "b").alias("target")]


def confidence_scores(graph: Graph) -> DataFrame:
    """Edges as links: source, target (in the last record's direction), relation, confidence, confidence_score."""
    return graph.edges.select(*_ends(), "relation", "confidence", _score(graph.edges).alias("confidence_score"))


def json_lines(graph: Graph) -> DataFrame:
    """The graph as JSON with all attributes that aren't null, one object in a row: kind (node, link or hyperedge) and json."""
    node = graph.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    rest = [c for c in graph.edges.columns if c not in ("a", "b", "src", "tgt", "confidence_score")]
    link = F.struct(*_ends(), F.col("src").isNotNull().alias("directed"), _score(graph.edges).alias("confidence_score"), *rest)
    rows = node.unionByName(graph.edges.select(F.lit("link").alias("kind"), F.to_json(link).alias("json")))
    if graph.hyperedges is not None:
        rows = rows.unionByName(graph.hyperedges.select(F.lit("hyperedge").alias("kind"), F.to_json(F.struct("*")).alias("json")))
    return rows


def write_json(graph: Graph, path: str) -> None:
    """Node-link JSON as text files, one folder for nodes, one for links and one for hyperedges, if there are any."""
    json_lines(graph).write.partitionBy("kind").text(path)


def read_json(spark: SparkSession, path: str) -> Graph:
    """The graph that write_json() has written, with the attributes that `schema` names."""
    lines = spark.read.text(path)
    nodes = lines.where("kind = 'node'").select(F.from_json("value", schema.NODE).alias("n")).select("n.*")
    links = lines.where("kind = 'link'").select(F.from_json("value", f"{schema.EDGE}, directed boolean").alias("e")).select("e.*")
    links = links.withColumns({"directed": F.coalesce("directed", F.lit(True)), "ord": F.coalesce("ord", F.concat_ws("|", "source", "target"))})
    groups = lines.where("kind = 'hyperedge'").select(F.from_json("value", schema.HYPEREDGE).alias("h")).select("h.*")
    built = Graph.build(nodes.withColumn("ord", F.coalesce("ord", "id")), links)
    return built if groups.isEmpty() else built.with_hyperedges(groups.withColumn("ord", F.coalesce("ord", "id")))


def file_names(nodes: DataFrame) -> DataFrame:
    """(id, file): safe names of notes; the n-th node with the same name gets `_n`, the first none."""
    base = vault_name(truncated_label(F.coalesce("label", "id")))
    rows = nodes.select("id", "ord", base.alias("base")).withColumn("key", F.regexp_replace("base", "[…. ]+$", ""))
    nth = F.row_number().over(W.partitionBy("key").orderBy("ord")) - 1
    return rows.select("id", F.when(nth > 0, F.concat("base", F.lit("_"), nth)).otherwise(F.col("base")).alias("file"))


def community_name(labels: DataFrame) -> Column:
    return F.coalesce("community_label", F.concat(F.lit("Community "), "community"))


def node_notes(graph: Graph, labels: DataFrame) -> DataFrame:
    """One Markdown note for each node: id, folder, file, note."""
    names = file_names(graph.nodes)
    rows = graph.nodes.join(labels.withColumnRenamed("label", "community_label"), "community", "left").join(names, "id").join(metrics.dominant_confidence(graph), "id")
    other = graph.nodes.select(F.col("id").alias("other"), F.coalesce("label", "id").alias("other_label")).join(names.select(F.col("id").alias("other"), F.col("file").alias("other_file")), "other")
    line = F.concat(F.lit("- [["), "other_file", F.lit("]] - `"), F.coalesce("relation", F.lit("")), F.lit("` ["), metrics.confidence(), F.lit("]"))
    near = graph.sides.join(other, "other").groupBy("id").agg(_joined([F.col("other_label"), F.col("other")], line).alias("near"))
    rows = rows.join(near, "id", "left")
    kind = F.coalesce("file_type", F.lit(""))
    name = F.coalesce("community_label", F.concat(F.lit("Community "), F.coalesce(F.col("community").cast("string"), F.lit("None"))))
    tags = F.array(F.concat(F.lit("wiki/"), F.when(kind == "", "document").otherwise(kind)), F.concat(F.lit("wiki/"), "confidence"), F.concat(F.lit("community/"), F.replace(name, F.lit(" "), F.lit("_"))))
    has = lambda c: c in graph.nodes.columns
    front = [F.lit("---"), F.concat(F.lit('source_file: "'), F.coalesce("source_file", F.lit("")), F.lit('"')), F.concat(F.lit('type: "'), kind, F.lit('"')), F.concat(F.lit('community: "'), name, F.lit('"'))]
    if has("source_location"):
        front.append(F.when(F.coalesce("source_location", F.lit("")) != "", F.concat(F.lit('location: "'), "source_location", F.lit('"'))))
    for c in ("pages", "page"):
        if has(c):
            front.append(F.concat(F.lit(f"{c}: "), F.col(c)))
    front += [F.lit("tags:"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n"), F.lit("---")]
    body = F.when(F.col("near").isNotNull(), F.concat(F.lit("## Connections\n"), "near", F.lit("\n\n"))).otherwise("")
    inline = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")
    note = F.concat(F.concat_ws("\n", *front), F.lit("\n\n# "), F.coalesce("label", "id"), F.lit("\n\n"), body, inline)
    return rows.select("id", F.when(kind == "", "other").otherwise(kind).alias("folder"), "file", note.alias("note"))


def community_notes(graph: Graph, labels: DataFrame) -> DataFrame:
    """One note for each community, with its members, ties to others and bridge nodes: community, file, note."""
    names, stats = file_names(graph.nodes), metrics.cohesion(graph)
    member = F.concat(F.lit("- [["), "file", F.lit("]]"), *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" - "), c)).otherwise("") for c in ("file_type", "source_file")])
    members = graph.nodes.where("community is not null").join(names, "id").groupBy("community").agg(_joined([F.coalesce("label", "id"), F.col("id")], member).alias("members"))
    named = labels.select("community", F.col("label").alias("community_label"))
    other = named.select(F.col("community").alias("other"), F.col("community_label").alias("other_label"))
    tie = F.concat(F.lit("- "), "edges", F.when(F.col("edges") == 1, " edge to [[_COMMUNITY_").otherwise(" edges to [[_COMMUNITY_"), vault_name(F.col("other_label")), F.lit("]]"))
    ties = metrics.community_links(graph).join(other, "other").groupBy("community").agg(_joined([-F.col("edges"), F.col("other")], tie).alias("ties"))
    bridge = F.concat(F.lit("- [["), "file", F.lit("]] - degree "), "degree", F.lit(", connects to "), "reach", F.when(F.col("reach") == 1, " community").otherwise(" communities"))
    tops = metrics.bridges(graph).join(names, "id").groupBy("community").agg(_joined([F.col("rank")], bridge).alias("tops"))
    rows = members.join(stats, "community").join(named, "community", "left").join(ties, "community", "left").join(tops, "community", "left")
    name, c = F.coalesce("community_label", F.concat(F.lit("Community "), "community")), F.col("cohesion")
    word = F.when(c >= 0.7, "tightly connected").when(c >= 0.4, "moderately connected").otherwise("loosely connected")
    live = F.concat(F.lit("## Live Query\n\n```dataview\nTABLE source_file, type FROM #community/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("\nSORT file.name ASC\n```\n"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n"), c, F.lit("\n")))
    note = F.concat_ws(
        "\n",
        F.concat(F.lit("---\ntype: community\ncohesion: "), two_digits(c), F.lit("\nmembers: "), "size", F.lit("\n---\n\n# "), name, F.lit("\n")),
        F.concat(F.lit("**Cohesion:** "), two_digits(c), F.lit(" - "), word),
        F.concat(F.lit("**Members:** "), "size", F.lit(" nodes\n\n## Members")),
        F.concat("members", F.lit("\n")), live, part("Connections to other communities", "ties"), part("Top bridge nodes", "tops"),
    )
    return rows.select("community", F.concat(F.lit("_COMMUNITY_"), vault_name(name)).alias("file"), note.alias("note"))


def vault_index(graph: Graph, labels: DataFrame) -> DataFrame:
    """The index's sections: section, place, text. Types by number of nodes, then the communities."""
    nodes = graph.degrees.join(file_names(graph.nodes), "id").withColumn("kind", F.when(F.coalesce("file_type", F.lit("")) == "", "other").otherwise(F.col("file_type")))
    line = F.concat(F.lit("- [["), "file", F.lit("]] — degree "), "degree", F.when(F.coalesce("source_file", F.lit("")) != "", F.concat(F.lit(" · `"), "source_file", F.lit("`"))).otherwise(""))
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n"), _joined([F.lower(F.coalesce("label", "id")), F.col("ord")], line).alias("entries"))
    place = F.row_number().over(W.orderBy(F.col("n").desc(), "kind"))
    title = F.concat(F.lit("## "), F.upper(F.substring("kind", 1, 1)), F.lower(F.substring("kind", 2, 200)), F.lit(" ("), "n", F.lit(")\n\n"))
    parts = kinds.select(F.col("kind").alias("section"), place.alias("place"), F.concat(title, "entries", F.lit("\n")).alias("text"))
    entry = F.concat(F.lit("- [[_COMMUNITY_"), vault_name(F.col("label")), F.lit("]] — "), "size", F.lit(" members · cohesion "), two_digits(F.col("cohesion")))
    listed = metrics.cohesion(graph).join(labels, "community").agg(F.count("*").alias("n"), _joined([F.col("community")], entry).alias("entries")).where("n > 0")
    groups = listed.select(F.lit("communities").alias("section"), F.lit(1_000_000).alias("place"), F.concat(F.lit("## Communities ("), "n", F.lit(")\n\n"), "entries", F.lit("\n")).alias("text"))
    counts = graph.nodes.agg(F.count("*").alias("n"), F.countDistinct("community").alias("c"))
    head = counts.select(
        F.lit("head").alias("section"), F.lit(0).alias("place"),
        F.concat(F.lit("---\ntype: vault-index\nnodes: "), "n", F.lit("\ncommunities: "), "c", F.lit("\n---\n\n# Vault Index\n\n"), "n", F.lit(" nodes across "), "c", F.lit(" communities.\n")).alias("text"),
    )
    return head.unionByName(parts).unionByName(groups)


def color_groups(labels: DataFrame) -> DataFrame:
    """Colours of communities in the vault's graph view: community, query, rgb."""
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.col("community") % len(COLORS) + 1).cast("int"))
    return labels.select("community", F.concat(F.lit("tag:#community/"), F.replace("label", F.lit(" "), F.lit("_"))).alias("query"), F.conv(F.substring(color, 2, 6), 16, 10).cast("long").alias("rgb"))


def wiki_articles(graph: Graph, labels: DataFrame, top: int = 25, ties: int = 12, sources: int = 20) -> DataFrame:
    """One article for each community: community, article."""
    own = graph.degrees.where("community is not null")
    place = F.row_number().over(W.partitionBy("community").orderBy(F.col("degree").desc(), "id"))
    line = F.concat(F.lit("- **"), F.coalesce("label", "id"), F.lit("** ("), "degree", F.lit(" connections)"), F.when(F.coalesce("source_file", F.lit("")) != "", F.concat(F.lit(" — `"), "source_file", F.lit("`"))).otherwise(""))
    key = own.withColumn("place", place).where(F.col("place") <= top).groupBy("community").agg(_joined([F.col("place")], line).alias("key"))
    other = labels.select(F.col("community").alias("other"), F.col("label").alias("other_label"))
    cross = metrics.community_links(graph).join(other, "other").groupBy("community", "other_label").agg(F.sum("edges").alias("edges"))
    cross = cross.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy(F.col("edges").desc(), "other_label"))).where(F.col("place") <= ties)
    cross = cross.groupBy("community").agg(_joined([F.col("place")], F.concat(F.lit("- [["), "other_label", F.lit("]] ("), "edges", F.lit(" shared connections)"))).alias("cross"))
    files = own.where("source_file <> ''").select("community", "source_file").distinct()
    files = files.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy("source_file"))).where(F.col("place") <= sources)
    files = files.groupBy("community").agg(_joined([F.col("place")], F.concat(F.lit("- `"), "source_file", F.lit("`"))).alias("files"))
    kinds = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
    audit = graph.sides.join(own.select("id", "community"), "id").groupBy("community").agg(*[F.count(F.when(metrics.confidence() == k, 1)).alias(k) for k in kinds], F.count("*").alias("total"))
    rows = metrics.cohesion(graph).join(labels, "community").join(key, "community")
    for part in (cross, files, audit):
        rows = rows.join(part, "community", "left")
    more = F.when(F.col("size") > top, F.concat(F.lit("\n- *... and "), F.col("size") - top, F.lit(" more nodes in this community*"))).otherwise("")
    shares = [F.concat(F.lit(f"- {k}: "), F.coalesce(k, F.lit(0)), F.lit(" ("), metrics.percent(F.coalesce(k, F.lit(0)), F.coalesce("total", F.lit(0))), F.lit("%)")) for k in kinds]
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), "label"), F.concat(F.lit("> "), "size", F.lit(" nodes · cohesion "), two_digits(F.col("cohesion"))),
        F.concat(F.lit("## Key Concepts\n\n"), "key", more),
        F.concat(F.lit("## Relationships\n\n"), F.coalesce("cross", F.lit("- No strong cross-community connections detected"))),
        F.concat(F.lit("## Source Files\n\n"), "files"),
        F.concat(F.lit("## Audit Trail\n\n"), F.concat_ws("\n", *shares)), F.lit(FOOTER),
    )
    return rows.select("community", text.alias("article"))


def god_articles(graph: Graph, labels: DataFrame, top_n: int = 10, shown: int = 20) -> DataFrame:
    """One article for each of the most connected nodes: id, article."""
    gods = metrics.god_nodes(graph, top_n).join(graph.nodes.select("id", "source_file", "community"), "id").join(labels.select("community", F.col("label").alias("community_label")), "community", "left")
    far = graph.degrees.select(F.col("id").alias("other"), F.coalesce("label", "id").alias("other_label"), "degree")
    near = graph.sides.join(gods.select("id"), "id", "left_semi").join(far, "other").withColumn("rel", F.coalesce("relation", F.lit("related")))
    near = near.withColumn("place", F.row_number().over(W.partitionBy("id", "rel").orderBy(F.col("degree").desc(), "other"))).where(F.col("place") <= shown)
    line = F.concat(F.lit("- [["), "other_label", F.lit("]]"), F.when(F.coalesce("confidence", F.lit("")) != "", F.concat(F.lit(" `"), "confidence", F.lit("`"))).otherwise(""))
    groups = near.groupBy("id", "rel").agg(_joined([F.col("place")], line).alias("lines"))
    groups = groups.groupBy("id").agg(_joined([F.col("rel")], F.concat(F.lit("### "), "rel", F.lit("\n"), "lines", F.lit("\n"))).alias("groups"))
    rows = gods.join(groups, "id", "left")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), "label"), F.concat(F.lit("> God node · "), "edges", F.lit(" connections · `"), F.coalesce("source_file", F.lit("")), F.lit("`")),
        F.concat(F.lit("**Community:** [["), "community_label", F.lit("]]")), F.concat(F.lit("## Connections by Relation\n\n"), F.coalesce("groups", F.lit(""))), F.lit(FOOTER),
    )
    return rows.select("id", text.alias("article"))


def chart_nodes(graph: Graph) -> DataFrame:
    """Nodes of the chart: id, label, community, color, degree, size, font. Of large graphs the best connected with some neighbours."""
    if graph.nodes.limit(MAX_CHART_NODES + 1).count() > MAX_CHART_NODES:
        top = graph.degrees.orderBy(F.col("degree").desc(), "ord").limit(CHART_TOP).select("id")
        near = graph.sides.join(top, "id", "left_semi").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("ord", "other"))).where(F.col("place") <= CHART_NEIGHBORS)
        graph = graph.induced(top.unionByName(near.select(F.col("other").alias("id"))))
    rows = graph.degrees
    most = rows.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.coalesce("community", F.lit(0)) % len(COLORS) + 1).cast("int"))
    rows = rows.join(F.broadcast(most))  # one row
    return rows.select(
        "id", sanitized(F.coalesce("label", "id")).alias("label"), F.coalesce("community", F.lit(0)).alias("community"), color.alias("color"), "degree",
        F.bround(10 + 30 * F.col("degree") / F.col("most"), 1).alias("size"), F.when(F.col("degree") >= F.col("most") * 0.15, 12).otherwise(0).alias("font"),
    )


def wiki_index(graph: Graph, labels: DataFrame) -> DataFrame:
    """The wiki's index: section, place, line. Communities, the largest first, then the most connected nodes."""
    counts = graph.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    counts = counts.join(graph.edges.agg(F.count("*").alias("edges")))  # rows of one
    # The index's sentences.
    intro = "> Auto-generated knowledge wiki. Start here — read community articles for context, then drill into god nodes for detail."
    before, after = ("# Knowledge Graph Index", "", intro, ""), ("", "---", "", "## Communities", "(sorted by size, largest first)", "")
    total = F.concat(F.lit("**"), "nodes", F.lit(" nodes · "), "edges", F.lit(" edges · "), "communities", F.lit(" communities**"))
    head = counts.select(F.posexplode(F.array(*map(F.lit, before), total, *map(F.lit, after))).alias("place", "line"))
    groups = metrics.cohesion(graph).join(labels.withColumnRenamed("label", "community_label"), "community", "left").withColumn("place", F.row_number().over(W.orderBy(F.col("size").desc(), "community")))
    groups = groups.select("place", F.concat(F.lit("- [["), community_name(labels), F.lit("]] — "), "size", F.lit(" nodes")).alias("line"))
    gods = metrics.god_nodes(graph).withColumn("place", F.row_number().over(W.orderBy(F.col("edges").desc(), "id")))
    title = F.when(F.col("place") == 1, "\n## God Nodes\n(most connected concepts — the load-bearing abstractions)\n\n").otherwise("")
    gods = gods.select("place", F.concat(title, F.lit("- [["), "label", F.lit("]] — "), "edges", F.lit(" connections")).alias("line"))
    foot = head.limit(1).select(F.lit(0).alias("place"), F.lit("\n---\n\n*Auto-generated knowledge wiki*").alias("line"))
    parts = [part.select(F.lit(i).alias("section"), F.col("place").cast("int").alias("place"), "line") for i, part in enumerate((head, groups, gods, foot), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_files(rows: DataFrame, path: str) -> int:
    """Writes `text` of each row (folder, file, text) to path/folder/file; returns how many. `path` lies in a store that all
    executors share; a task that runs again writes the same files again."""
    target = path if "://" in path else os.path.abspath(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        for pdf in batches:
            for folder in pdf["folder"].unique():
                store.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
            for folder, file, text in zip(pdf["folder"], pdf["file"], pdf["text"]):
                with store.open_output_stream("/".join(x for x in (root, folder, file) if x)) as out:
                    out.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("folder", "file", "text").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_vault(graph: Graph, labels: DataFrame, path: str) -> int:
    """The vault: a note for each node in its type's folder, for each community in `communities`, the index, and the graph
    view's colours. Returns the number of notes."""
    notes = node_notes(graph, labels).select("folder", F.concat("file", F.lit(".md")).alias("file"), F.col("note").alias("text"))
    groups = community_notes(graph, labels).select(F.lit("communities").alias("folder"), F.concat("file", F.lit(".md")).alias("file"), F.col("note").alias("text"))
    index = vault_index(graph, labels).agg(_joined([F.col("place")], F.col("text")).alias("text"))
    color = F.struct("query", F.struct(F.lit(1).alias("a"), "rgb").alias("color"))
    colors = color_groups(labels).agg(F.array_sort(F.collect_list(F.struct("community", color.alias("group")))).alias("groups"))
    colors = colors.select(F.to_json(F.struct(F.transform("groups", lambda g: g["group"]).alias("colorGroups"))).alias("text"))
    rest = index.select(F.lit("").alias("folder"), F.lit("index.md").alias("file"), "text")
    rest = rest.unionByName(colors.select(F.lit(".vault").alias("folder"), F.lit("graph.json").alias("file"), "text"))
    return write_files(notes.unionByName(groups).unionByName(rest), path) - 2


def write_wiki(graph: Graph, labels: DataFrame, path: str) -> int:
    """The wiki: an article for each community and each of the most connected nodes, and the index. Of articles with one name
    a node's comes first. Returns the number of articles."""
    named = labels.withColumnRenamed("label", "community_label")
    groups = wiki_articles(graph, labels).join(named, "community", "left").select(F.struct(F.lit(0).alias("kind"), F.col("community").cast("string").alias("key")).alias("rank"), vault_name(community_name(labels)).alias("file"), F.col("article").alias("text"))
    gods = god_articles(graph, labels).join(graph.nodes.select("id", F.coalesce("label", "id").alias("name")), "id")
    gods = gods.select(F.struct(F.lit(1).alias("kind"), F.col("id").alias("key")).alias("rank"), vault_name(F.col("name")).alias("file"), F.col("article").alias("text"))
    articles = groups.unionByName(gods).groupBy("file").agg(F.max_by("text", "rank").alias("text")).select(F.lit("").alias("folder"), F.concat("file", F.lit(".md")).alias("file"), "text")
    index = wiki_index(graph, labels).agg(_joined([F.col("section"), F.col("place")], F.col("line")).alias("text"))
    return write_files(articles.unionByName(index.select(F.lit("").alias("folder"), F.lit("index.md").alias("file"), "text")), path) - 1
