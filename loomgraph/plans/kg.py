"""The canonical graph over the given tables, rendered notes and rendered source files.

Nodes: the star schema's dimensions, documents, pages, words of page navigation (entities) and images (vectors).
Edges: the schema's hierarchy, supply of parts, page links, mentions of entities in documents, equal texts, and doubtful
relations of toxic documents. `community` is a partition that the tables give, so that SQL can check what builds on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Graph, upsert_edges, upsert_nodes
from ..operators.paths import stored
from ..operators.xref import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(rank: int, key: Column) -> Column:
    text = key.cast("string")
    return F.concat(F.lit(f"{rank}:"), F.when(F.length(text) < 12, F.lpad(text, 12, "0")).otherwise(text))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, h1, html."""
    host, h1 = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), h1.alias("h1"), "html")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, word): distinct link texts of three ASCII letters or more."""
    found = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("word"))
    return rows.where(F.col("word").rlike("^[a-z]{3,}$"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_file, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("source_file"), "text")


def mentions(spark: SparkSession, sf_dir: str, entities: DataFrame) -> DataFrame:
    """(doc_id, word): entities (word) that a document's text names."""
    said = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    return said.join(entities, "word", "left_semi").select("doc_id", "word")


def node_records(spark: SparkSession, sf_dir: str, entities: DataFrame) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def part(df: DataFrame, kind: str, key: str, label: Column, file_type: str, source_file: Column, community: Column, rank: int) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"), source_file.alias("source_file"), community.cast("int").alias("community"), _key(rank, F.col(key)).alias("ord")
        )

    own = lambda name: F.lit(f"tpch/{name}.py")
    id_of = lambda head, key, tail: F.concat(F.lit(head), F.col(key).cast("string"), F.lit(tail))
    parts = [
        part(t("region"), "region", "r_regionkey", F.col("r_name"), "code", own("region"), F.col("r_regionkey"), 1),
        part(t("nation"), "nation", "n_nationkey", F.col("n_name"), "code", own("nation"), F.col("n_regionkey"), 2),
        part(t("customer"), "customer", "c_custkey", F.col("c_name"), "code", own("customer"), F.col("c_nationkey") % 5, 3),
        part(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "code", own("supplier"), F.col("s_nationkey") % 5, 4),
        part(t("part"), "part", "p_partkey", F.col("p_name"), "code", own("part"), 5 + F.col("p_size") % 5, 5),
        part(documents(spark, sf_dir), "doc", "doc_id", id_of("doc-", "doc_id", ""), "document", F.col("source_file"), 10 + F.col("doc_id") % 4, 6),
        part(pages(spark, sf_dir), "page", "page_id", F.col("h1"), "paper", F.concat("host", F.lit("/page_"), "page_id", F.lit(".pdf")), 14 + F.col("page_id") % 3, 7),
        part(entities, "ent", "word", F.col("word"), "code", F.concat(F.lit("nav/"), F.substring("word", 1, 1), F.lit(".py")), 17 + F.ascii("word") % 4, 8),
        part(t("embeddings"), "img", "vec_id", id_of("vec-", "vec_id", ""), "image", id_of("img/vec_", "vec_id", ".png"), 30 + F.col("label"), 9),
    ]
    return reduce(DataFrame.unionByName, parts)


def edge_records(spark: SparkSession, sf_dir: str, links: DataFrame, said: DataFrame) -> DataFrame:
    """`links` are anchors(), `said` mentions()."""
    t = lambda name: table(spark, sf_dir, name)

    def part(df: DataFrame, source: Column, target: Column, relation: str, confidence: str, rank: int) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.concat(F.lit(f"{rank}:"), source, F.lit(":"), target).alias("ord"))

    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    supply = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    docs = t("documents").where("text is not null")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    same = docs.select("doc_id", F.sha2("text", 256).alias("h")).join(first, "h").where("doc_id <> first_id")
    toxic = t("labels").where("toxic = 1").select("doc_id").distinct().join(said, "doc_id").groupBy("doc_id").agg(F.min("word").alias("word"))
    parts = [
        part(t("nation"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "contains", "EXTRACTED", 1),
        part(t("customer"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "contains", "EXTRACTED", 2),
        part(t("supplier"), ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "contains", "EXTRACTED", 3),
        part(supply, ref("supplier", "l_suppkey"), ref("part", "l_partkey"), "uses", "INFERRED", 4),
        part(links, ref("page", "page_id"), ref("ent", "word"), "references", "EXTRACTED", 5),
        part(said, ref("doc", "doc_id"), ref("ent", "word"), "mentions", "INFERRED", 6),
        part(same, ref("doc", "first_id"), ref("doc", "doc_id"), "same_concept", "INFERRED", 7),
        part(toxic, ref("doc", "doc_id"), ref("ent", "word"), "related_to", "AMBIGUOUS", 8),
    ]
    return reduce(DataFrame.unionByName, parts)


def hyperedge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nodes: the parts of each order, said again (and to be passed over) of every third, and packs without label; records without id count for nothing."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))).alias("nodes"))
    key = F.col("l_orderkey").cast("string")

    def group(rows: DataFrame, id_: Column, label: Column, relation: str, sure: str | None, score: Column, rank: int) -> DataFrame:
        return rows.select(id_.alias("id"), label.alias("label"), "nodes", F.lit(relation).alias("relation"), F.lit(sure).cast("string").alias("confidence"), score.cast("double").alias("confidence_score"), F.lit("").alias("source_file"), F.concat(F.lit(f"{rank}:"), F.lpad(key, 12, "0")).alias("ord"))

    said = group(parts, F.concat(F.lit("order:"), key), F.concat(F.lit("Order "), key), "participate_in", "INFERRED", (F.col("l_orderkey") % 100) / 100, 1)
    again = group(parts.where("l_orderkey % 3 = 0"), F.concat(F.lit("order:"), key), F.lit("said again"), "form", "AMBIGUOUS", F.lit(None), 2)
    plain = group(parts.where("l_orderkey % 7 = 0"), F.concat(F.lit("pack:"), key), F.lit(None).cast("string"), "form", None, F.lit(None), 3)
    return said.unionByName(again).unionByName(plain).unionByName(group(parts.where("l_orderkey % 50 = 0"), F.lit(""), F.lit("no id"), "form", None, F.lit(None), 0))


_BUILT: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The built graph. It is computed once in a session and written to the shared folder, as a saved graph would be. So are the pages'
    links, the entities and their mentions, which several kinds of nodes and edges are made from."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        links = stored(anchors(spark, sf_dir), "links")
        entities = stored(links.select("word").distinct(), "entities")
        said = stored(mentions(spark, sf_dir, entities), "mentions")
        nodes = stored(upsert_nodes(node_records(spark, sf_dir, entities)), "nodes")
        _BUILT[key] = Graph(nodes, stored(upsert_edges(edge_records(spark, sf_dir, links, said), nodes), "edges"))
    return _BUILT[key]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, doc_id, text: each document rendered as a Markdown note with headings, terms, links and fenced code."""
    n = F.col("doc_id").cast("string")
    other = (F.col("doc_id") + 1).cast("string")
    bold = F.concat(F.lit("**Doc "), n, F.lit("**\n\nintro\n\n**Ends with a stop.**\n\n**Part "), "source", F.lit("**\n\n"))
    hashed = F.concat(F.lit("# Doc "), n, F.lit("\n\n## Source "), "source", F.lit("\n\n### Deep "), n, F.lit("\n\n## Source "), "source", F.lit("\n\n# Other "), n, F.lit("\n\n## Overview\n\n"))
    rest = F.concat(
        F.lit("- **Term "), "lang", F.lit("**: meaning\n* **x=y**: noise\n- **Doc "), n, F.lit("**: again\n\n[next](../src0/./doc_"), other, F.lit(".md#top) [web](https://example.com) ![img](pic.png) [next](../src0/doc_"), other,
        F.lit(".md)\n\nSee [[doc-"), n, F.lit("]] and [[ghost-"), n, F.lit("#a]].\n\n```\n# fenced\n[[InFence]]\n```\n\n[[ doc-"), other, F.lit(" ]]\n"),
    )
    rows = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, bold).otherwise(hashed), rest, F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.concat("source", F.lit("/doc_"), n, F.lit(".md")).alias("source_file"), F.lit("document").alias("file_type"), text.alias("text"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table that much work comes from, dealt to all cores: its file alone may be one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, text: each part rendered as a Python module whose class builds on the next part's."""
    k, after = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    text = F.concat(
        F.lit('"""Module of '), "p_name", F.lit(' with all its parts."""\nimport os\nfrom .part_'), after, F.lit(" import Part"), after, F.lit("\n\n\nclass Part"), k, F.lit("(Part"), after,
        F.lit('):\n    """Class of brand '), "p_brand", F.lit(' and type."""\n\n    def price(self):\n        return helper_'), k, F.lit("(self)\n\n\ndef helper_"), k, F.lit("(x):\n    # NOTE: size "), F.col("p_size").cast("string"),
        F.lit("\n    return os.path.join(str(x))\n"),
    )
    parts = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return parts.select("p_partkey", F.concat(F.lit("parts/part_"), k, F.lit(".py")).alias("source_file"), text.alias("text"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, text: each supplier rendered as a Python module; even ones have nested and decorated functions and names declared
    twice, odd ones classes, functions and imports in branches, and a base class of their own."""
    twice = """import os


class Till@K:
    @property
    def price(self):
        return self._price

    @price.setter
    def price(self, value):
        self._price = helper_@K(value)


@wraps_@K
def helper_@K(x):
    def inner(y):
        return other_@K(y)

    return os.path.join(str(x))


def other_@K(x):
    return x


def other_@K(x, y):
    return helper_@K(y)
"""
    branches = """try:
    import json
except ImportError:
    from .shop_0 import Till0

if True:
    class Base@K:
        pass

    class Till@K(Base@K):
        async def load(self, n: int=1) -> list:
            return helper_@K(n)
else:
    def helper_@K(x):
        # WHY: shop @K
        return Till@K()
"""
    k = F.col("s_suppkey").cast("string")
    body = F.replace(F.when(F.col("s_suppkey") % 2 == 0, twice).otherwise(branches), F.lit("@K"), k)
    text = F.concat(F.lit('"""Shop of '), "s_name", F.lit(' and others."""\n'), body)
    suppliers = _spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))
    return suppliers.select("s_suppkey", F.concat(F.lit("shops/shop_"), k, F.lit(".py")).alias("source_file"), text.alias("text"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, text: each supplier rendered as a Java file with doc comments."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("import java.util.List;\n\n/**\n * Supplier "), "s_name", F.lit(" of the schema.\n * @since 1\n */\npublic class Supplier"), k, F.lit(" extends Nation"), F.col("s_nationkey").cast("string"),
        F.lit(" implements Runnable {\n    /** Runs the supplier once a day. */\n    public void run() {\n    }\n}\n"),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("java/Supplier"), k, F.lit(".java")).alias("source_file"), text.alias("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text of the conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
