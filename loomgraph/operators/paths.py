"""Shortest paths and components, by joins of frontiers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .build import Graph


def ensure_checkpoints(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; on one machine (a local master) a temporary folder where it isn't set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp"))


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs that begin here go when their job is over, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once, in the shared folder, with its lineage cut. Its shuffle files don't outlive it."""
    ensure_checkpoints(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: smaller than a checkpoint, read by column, and of known size. It stays as long as the folder."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reached(graph: Graph, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Nodes reachable from `starts` (id), however far without `max_hops`: id, hops and the smallest path (ids) of that length."""
    sides = cut(graph.sides.select("id", "other").where("id <> other"))
    seen = cut(starts.select("id", F.lit(0).alias("hops"), F.array("id").alias("path")))
    frontier = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        step = frontier.join(sides, "id").select(F.col("other").alias("id"), F.concat("path", F.array("other")).alias("path"))
        step = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = cut(step.select("id", F.lit(hop).alias("hops"), "path"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_path(graph: Graph, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """The steps of the shortest path between two ids (the smallest, if there are several): hop, id, label, relation."""
    sides = cut(graph.sides.select("id", "other").where("id <> other"))
    spark = sides.sparkSession
    seen = frontier = cut(spark.createDataFrame([(source, [source])], "id string, path array<string>"))
    for _ in count() if max_hops is None else range(max_hops):
        if not seen.where(F.col("id") == target).isEmpty():
            break
        step = frontier.join(sides, "id").select(F.col("other").alias("id"), F.concat("path", F.array("other")).alias("path"))
        frontier = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti").select("id", "path"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    steps = seen.where(F.col("id") == target).select(F.posexplode("path").alias("hop", "id"), F.col("path").alias("whole"))
    steps = steps.withColumn("before", F.get("whole", F.col("hop") - 1))
    ends = [F.least("id", "before").alias("a"), F.greatest("id", "before").alias("b")]
    steps = steps.select("hop", "id", *ends).join(graph.edges.select("a", "b", "relation"), ["a", "b"], "left").join(graph.nodes.select("id", "label"), "id", "left")
    return steps.select("hop", "id", "label", F.when(F.col("hop") > 0, F.col("relation")).alias("relation"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with a column that numbers its rows from 0 in the order of columns. Ranges of rows are sorted each in a task of its own;
    their lengths, one row for each task, give their first numbers."""
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(sorted_parts.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    lengths = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = lengths.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    met = rows.withColumn("_part", part).join(before, "_part")
    return met.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def components(graph: Graph, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node is connected with."""
    return linked(graph.nodes.select("id"), graph.sides.select("id", "other"), max_rounds)


def linked(ids: DataFrame, sides: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) over sides (id, other), both directions of each edge. Labels jump along and over edges until they rest."""
    sides = cut(sides)
    labels = cut(ids.select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        near = sides.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        over = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(over, "component").select("id", "old", F.least("component", "further").alias("component")))
        labels = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
