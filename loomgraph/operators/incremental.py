"""Skipping work that is already done: content hashes, manifests, cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raised when extraction changes, so that older results no longer count.
CACHE_VERSION = 2


def content_key(content: Column, path: Column, version: int = CACHE_VERSION) -> Column:
    """SHA-256 of a file's bytes, its path and the version of extraction."""
    tail = F.concat(F.lit("\0"), path, F.lit(f"\0v{version}"))
    return F.sha2(F.concat(content.cast("binary"), tail.cast("binary")), 256)


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (key, ...) without a cached result."""
    return files.join(cache.select("key"), "key", "left_anti")


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached results of files that haven't changed."""
    return cache.join(files.select("key"), "key", "left_semi")


def refreshed(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh results in the place of older ones of the same source file."""
    return cache.join(fresh.select("source_file"), "source_file", "left_anti").unionByName(fresh)


def changes(before: DataFrame, after: DataFrame, younger: bool = True) -> DataFrame:
    """(path, status) between two manifests (path, mtime): new, modified, unchanged or deleted.

    A file counts as modified if it is younger than before, or without `younger` if its time is another one.
    """
    joined = before.withColumnRenamed("mtime", "old").join(after.withColumnRenamed("mtime", "now"), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("old") if younger else F.col("now") != F.col("old"), "modified").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that a watcher rebuilds for: added, or of another time than before. Deletions don't count."""
    return after.exceptAll(before).select("path").distinct()


def apply_changes(table: DataFrame, fresh: DataFrame, status: DataFrame) -> DataFrame:
    """A table of records by source_file after re-extraction: stale and deleted files' records go, fresh ones come."""
    stale = status.where("status <> 'unchanged'").select(F.col("path").alias("source_file"))
    return table.join(stale, "source_file", "left_anti").unionByName(fresh)
