"""Session logs: JSON lines whose first line is a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.capture import flattened, session_name


def sessions(spark: SparkSession, path: str, project: str | None = None, hours: int | None = None) -> DataFrame:
    """Messages of logs: session, role, text, ts. Of one project and of files changed in the last hours, if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    if hours is not None:
        files = files.where(F.col("modificationTime") >= F.current_timestamp() - F.expr(f"interval {int(hours)} hours"))
    rows = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "json"))
    if project is not None:
        owned = rows.where((F.col("at") == 0) & (F.get_json_object("json", "$.cwd") == project)).select("path")
        rows = rows.join(owned, "path", "left_semi")
    return rows.where("at > 0").select(
        session_name(F.col("path")).alias("session"), F.get_json_object("json", "$.role").alias("role"), flattened(F.get_json_object("json", "$.content")).alias("text"), F.get_json_object("json", "$.ts").alias("ts")
    ).where("role is not null")
