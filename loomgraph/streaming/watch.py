"""Watching a folder: every tick of a stream lists it, and what differs from the list before goes to an action.

Lists are tables beside the stream's checkpoint, one for each batch, and are compared by a join, so a file that changes under its old path
is seen, and so is one that goes. A batch's list is written before its action runs; if the action fails, the batch runs again and is
compared with the same list as before, so no change is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import changes
from ..sources.files import listing

MANIFEST = "path string, mtime long, length long"


def manifest(spark: SparkSession, root: str, glob: str = "*", ignore: list[str] | None = None) -> DataFrame:
    """path (from the root), mtime, length of the files that a watcher looks at."""
    fits = F.lit(glob).isin("*", "") if glob in ("*", "") else F.regexp_extract("path", "[^/]+$", 0).rlike("^" + glob.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$")
    return listing(spark, root, ignore).select(F.col("source_file").alias("path"), "mtime", "length").where(fits)


def _folder(spark: SparkSession, path: str):
    """Hadoop's view of a path: file system and path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose lists are there."""
    system, folder = _folder(spark, path)
    return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()) if system.exists(folder) else []


def watch(
    spark: SparkSession, root: str, action: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", available_now: bool = True, every: str = "5 seconds", ignore: list[str] | None = None
) -> StreamingQuery:
    """Calls `action` with the changes (path from the root, status `new`, `modified` or `deleted`) of each batch that has any.

    With `available_now` the folder is listed once; else again and again, `every` so often.
    """
    lists = f"{checkpoint}/manifests"

    def tick(_: DataFrame, batch: int) -> None:
        earlier = [n for n in _batches(spark, lists) if n < batch]
        before = spark.read.schema(MANIFEST).parquet(f"{lists}/{earlier[-1]}") if earlier else spark.createDataFrame([], MANIFEST)
        manifest(spark, root, glob, ignore).write.mode("overwrite").parquet(f"{lists}/{batch}")
        version = F.struct("mtime", "length").alias("mtime")
        after = spark.read.schema(MANIFEST).parquet(f"{lists}/{batch}")
        found = changes(before.select("path", version), after.select("path", version), younger=False).where("status <> 'unchanged'")
        if not found.isEmpty():
            action(found, batch)
        for n in earlier[:-1]:
            system, old = _folder(spark, f"{lists}/{n}")
            system.delete(old, True)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
