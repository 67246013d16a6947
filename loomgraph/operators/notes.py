"""Notes that feed the next build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import secret_label
from ..functions.text import slug

TITLE_LENGTH = 80


def heading(title: Column, text: Column) -> Column:
    """A note's title, else its first line; 80 characters."""
    return F.regexp_replace(F.substring(F.coalesce(title, F.substring_index(text, "\n", 1)), 1, TITLE_LENGTH), r"(?U)^\s+|\s+$", "")


def notes(rows: DataFrame, allow_secrets: bool = False) -> DataFrame:
    """Notes from rows (text, title, links, tags, written): adds heading, file and content.

    Empty texts and, unless allowed, texts with secrets make no note: `rejected` says why.
    """
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("clean", clean).withColumn("heading", heading(F.col("title"), F.col("clean")))
    secret = F.lit(None).cast("string") if allow_secrets else secret_label(F.col("clean"))
    rejected = F.when(F.col("clean") == "", "note text is empty").otherwise(F.concat(F.lit("note holds a secret: "), secret))
    inline = lambda name: F.when(F.size(F.coalesce(name, F.array())) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(name, ", "), F.lit("]")))
    front = F.concat_ws("\n", F.lit("---"), F.lit("type: insight"), F.concat(F.lit("date: "), F.date_format("written", "yyyy-MM-dd'T'HH:mm:ss")), inline("tags"), inline("links"), F.lit("---"))
    named = F.array_join(F.transform("links", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    related = F.when(F.size(F.coalesce("links", F.array())) > 0, F.concat(F.lit("\n\n**Related:** "), named)).otherwise("")
    content = F.concat(front, F.lit("\n\n# "), "heading", F.lit("\n\n"), "clean", related, F.lit("\n"))
    file = F.concat(F.lit("note-"), F.date_format("written", "yyyyMMdd-HHmmss"), F.lit("-"), slug(F.col("heading")), F.lit(".md"))
    return rows.withColumns({"rejected": rejected, "file": file, "content": content}).drop("clean")


def log_line(ts: Column, op: Column, text: Column) -> Column:
    """One line of the activity log."""
    return F.concat(F.lit("## ["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("] ["), op, F.lit("] | "), text)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows (ts, op, text) to the log, a table of (ts, op, text, line)."""
    rows.select("ts", "op", "text", log_line(F.col("ts"), F.col("op"), F.col("text")).alias("line")).write.mode("append").parquet(path)
