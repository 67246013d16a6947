"""A graph that is kept up to date: what each source file said is stored beside it, so a change costs what it touches.

Tables lie in one folder, dealt to buckets by a hash of a key; an update reads and replaces only the buckets of what it touches.

    said_nodes, said_edges   records with their `file`, by id and by pair
    said_by                  file -> ids and pairs that it has said something about, by file
    nodes                    built nodes, by id
    sides                    built edges under both of their ends, by end; also those whose other end is no node (yet)
    labels, members          component of each node, by id and by component

An update upserts the touched ids and pairs anew from all that is said about them. Where edges or nodes only came, components are
joined by their labels; where some went, the components that had them are settled anew. Results equal those of a build from
nothing, whatever the order of updates; `ord` orders records as in a build, so it must not depend on other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .build import Graph, upsert_edges, upsert_nodes
from .paths import cut, linked

BUCKETS = 256


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Upkeep:
    """The stored graph in the folder `path` of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Rows read and replaced by updates, by table.
        self.read_rows: dict[str, int] = {}

    # Tables in buckets

    def _schema(self, name: str) -> StructType:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("bucket").schema

    def _whole(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("bucket")

    def _part(self, name: str, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """The buckets of a table that hold these keys (key), and their numbers."""
        buckets = sorted(r["b"] for r in keys.select(_bucket(F.col("key")).alias("b")).distinct().collect())
        rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets)).drop("bucket")
        return rows, buckets

    def _write(self, name: str, rows: DataFrame, key: Column, mode: str = "static", empty: tuple[int, ...] = (0,)) -> None:
        """Writes buckets. The `empty` ones get a row without key, which reads as none."""
        none = self.spark.createDataFrame([(b,) for b in empty], "bucket int")
        keyed = rows.withColumn("bucket", _bucket(key)).unionByName(none, allowMissingColumns=True)
        keyed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _replace(self, name: str, key: Column, keys: DataFrame, change) -> None:
        """Rewrites the buckets of `keys` with change(rows)."""
        rows, buckets = self._part(name, keys)
        kept = rows.where(key.isNotNull())
        new = cut(change(kept))
        self.read_rows[name] = self.read_rows.get(name, 0) + kept.count()
        filled = {r["b"] for r in new.select(_bucket(key).alias("b")).distinct().collect()}
        self._write(name, new, key, "dynamic", tuple(sorted(set(buckets) - filled)))

    # The graph

    @staticmethod
    def _pair(a: str = "a", b: str = "b") -> Column:
        return F.concat(a, F.lit("\0"), b)

    def create(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Stores records of nodes (file, id, ..., ord) and edges (file, source, target, ..., ord), and the graph that they make."""
        nodes, edges = cut(nodes), cut(edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")}))
        self._write("said_nodes", nodes, F.col("id"))
        self._write("said_edges", edges, self._pair())
        self._write("said_by", self._said_by(nodes, edges), F.col("file"))
        self._write("nodes", upsert_nodes(nodes.drop("file")), F.col("id"))
        self._write("sides", self._sides(edges), F.col("id"))
        graph = self.graph()
        labels = linked(graph.nodes.select("id"), graph.sides.select("id", "other"))
        self._write("labels", labels, F.col("id"))
        self._write("members", labels, F.col("component"))

    @staticmethod
    def _said_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        return nodes.select("file", "id", none.alias("a"), none.alias("b")).unionByName(edges.select("file", none.alias("id"), "a", "b")).distinct()

    @staticmethod
    def _sides(edges: DataFrame) -> DataFrame:
        """Upserted edges under both ends."""
        built = upsert_edges(edges.drop("file", "a", "b"))
        return built.select(F.col("a").alias("id"), "*").unionByName(built.where("a <> b").select(F.col("b").alias("id"), "*"))

    def graph(self) -> Graph:
        """The graph as it is now; edges with an end that is no node are left out."""
        nodes = self._whole("nodes").where("id is not null")
        edges = self._whole("sides").where("id = a").drop("id")
        for end in ("a", "b"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        return Graph(nodes, edges.select("a", "b", *[c for c in edges.columns if c not in ("a", "b")]))

    def components(self) -> DataFrame:
        return self._whole("labels").where("id is not null").select("id", "component")

    def update(self, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """Puts fresh records in the place of all that `files` (file) have said; files without fresh records are gone."""
        files = cut(files.select("file").distinct())
        nodes = cut(nodes.join(files, "file", "left_semi").select(self._schema("said_nodes").names))
        edges = edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
        edges = cut(edges.join(files, "file", "left_semi").select(self._schema("said_edges").names))
        fresh = cut(self._said_by(nodes, edges))
        of_files, _ = self._part("said_by", files.withColumnRenamed("file", "key"))
        before = cut(of_files.join(files, "file", "left_semi").unionByName(fresh))
        ids = cut(before.where("id is not null").select(F.col("id").alias("key")).distinct())
        pairs = cut(before.where("a is not null").select("a", "b", self._pair().alias("key")).distinct())
        gone = lambda rows: rows.join(files, "file", "left_anti")
        self._replace("said_by", F.col("file"), files.withColumnRenamed("file", "key"), lambda rows: gone(rows).unionByName(fresh))
        self._replace("said_nodes", F.col("id"), ids, lambda rows: gone(rows).unionByName(nodes))
        self._replace("said_edges", self._pair(), pairs, lambda rows: gone(rows).unionByName(edges))

        # The touched ids and pairs, built anew.
        said, _ = self._part("said_nodes", ids)
        built = cut(upsert_nodes(said.join(ids.withColumnRenamed("key", "id"), "id", "left_semi").drop("file")))
        had, _ = self._part("nodes", ids)
        had = cut(had.join(ids.withColumnRenamed("key", "id"), "id", "left_semi").select("id"))
        came, went = cut(built.select("id").join(had, "id", "left_anti")), cut(had.join(built.select("id"), "id", "left_anti"))
        self._replace("nodes", F.col("id"), ids, lambda rows: rows.join(ids.withColumnRenamed("key", "id"), "id", "left_anti").unionByName(built.select(rows.columns)))
        said, _ = self._part("said_edges", pairs)
        sides = cut(self._sides(said.join(pairs.select("a", "b"), ["a", "b"], "left_semi")))
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        old, _ = self._part("sides", ends)
        old = cut(old.join(pairs.select("a", "b"), ["a", "b"], "left_semi").where("id = a").select("a", "b"))
        lost = cut(old.join(sides.select("a", "b"), ["a", "b"], "left_anti"))
        self._replace("sides", F.col("id"), ends, lambda rows: rows.join(pairs.select("a", "b"), ["a", "b"], "left_anti").unionByName(sides.select(rows.columns)))
        self._mend(came, went, sides.where("id = a").select("a", "b"), lost)

    def _near(self, ids: DataFrame) -> DataFrame:
        """Sides (id, other) of nodes (id) whose other end is a node."""
        sides, _ = self._part("sides", ids.select(F.col("id").alias("key")))
        sides = sides.join(ids.select("id"), "id", "left_semi").select("id", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
        known, _ = self._part("nodes", sides.select(F.col("other").alias("key")))
        return sides.join(known.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")

    def _labels(self, ids: DataFrame) -> DataFrame:
        found, _ = self._part("labels", ids.select(F.col("id").alias("key")))
        return found.join(ids.select("id"), "id", "left_semi").select("id", "component")

    def _mend(self, came: DataFrame, went: DataFrame, new: DataFrame, lost: DataFrame) -> None:
        """Component labels after nodes and edges came and went."""
        ends = cut(lost.select(F.explode(F.array("a", "b")).alias("id")).unionByName(went).distinct())
        broken = cut(self._labels(ends).select("component").distinct())
        members, _ = self._part("members", broken.select(F.col("component").alias("key")))
        apart = cut(members.join(broken, "component", "left_semi").select("id").join(went, "id", "left_anti"))
        # Components that lost something are settled by themselves first; what came then joins components by their labels.
        inside = self._near(apart).join(apart.withColumnRenamed("id", "other"), "other", "left_semi")
        fresh = cut(linked(apart, inside).unionByName(came.select("id", F.col("id").alias("component"))))
        links = new.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(self._near(came))
        links = cut(links.distinct())
        outer = links.select(F.explode(F.array("id", "other")).alias("id")).distinct().join(fresh, "id", "left_anti").join(went, "id", "left_anti")
        known = cut(self._labels(outer).unionByName(fresh))
        of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
        joined = links.join(of("id"), "id").join(of("other"), "other").where("id_c <> other_c")
        both = joined.select(F.col("id_c").alias("id"), F.col("other_c").alias("other"))
        both = cut(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
        renamed = linked(both.select("id").distinct(), both).where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("top"))
        renamed = cut(renamed)
        old, _ = self._part("members", renamed.select(F.col("component").alias("key")))
        moved = old.join(fresh.select("id").unionByName(went), "id", "left_anti").select("id", "component").unionByName(fresh.select("id", "component"))
        moved = moved.join(renamed, "component", "left")
        changed = cut(moved.where(F.col("top").isNotNull()).select("id", F.col("top").alias("component")).unionByName(moved.where("top is null").join(fresh.select("id"), "id", "left_semi").select("id", "component")))
        # All that has a new label leaves the row of its old one.
        touched = cut(changed.select("id").unionByName(went).distinct())
        before = cut(self._labels(touched))
        self._replace("labels", F.col("id"), touched.select(F.col("id").alias("key")), lambda rows: rows.join(touched, "id", "left_anti").unionByName(changed.select(rows.columns)))
        at = cut(before.select(F.col("component").alias("key")).unionByName(changed.select(F.col("component").alias("key"))).distinct())
        self._replace("members", F.col("component"), at, lambda rows: rows.join(touched, "id", "left_anti").unionByName(changed.select(rows.columns)))
