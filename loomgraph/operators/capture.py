"""Decisions in session logs: candidates, tags, links and the file that proposes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import has_secret
from ..functions.text import WIKILINK
from .xref import WORD, looked_up

# What a message must say to be a candidate, and the tags it suggests.
KEYWORDS = ("vì", "lý do", "because", "rationale", "trade-off", "tradeoff", "decided", "design choice")
MIN_LENGTH = 50
TAGS = (("decision", ("decided", "decision", "design choice")), ("rationale", ("rationale", "lý do", "vì", "because")), ("tradeoff", ("trade-off", "tradeoff")))


def says(text: Column, words) -> Column:
    """True if a text holds one of the words, whole and in any case."""
    return text.rlike(r"(?iuU)\b(" + "|".join(words) + r")\b")


def flattened(content: Column) -> Column:
    """The text of a message's JSON content: a string as it is, the text blocks of a list joined by blanks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    text = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(F.trim(content).startswith("["), F.array_join(text, " ")).otherwise(F.coalesce(F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "s string")["s"], content))


def candidates(messages: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """Messages (role, text, ...) worth a note: by the user, long enough, without secrets, with a keyword."""
    return messages.where((F.col("role") == "user") & (F.length("text") >= MIN_LENGTH) & says(F.col("text"), keywords) & ~has_secret(F.col("text")))


def tags(text: Column) -> Column:
    """Sorted tags that a text suggests."""
    return F.array_sort(F.array_compact(F.array(*[F.when(says(text, words), F.lit(tag)) for tag, words in TAGS])))


def links(messages: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, links): [[links]] of a message and graph labels it names, case as written, sorted.

    Labels of one word join on words. Others join on their rarest word, then the whole label must stand between boundaries. Only the
    messages' words are dealt out for that, and the texts of those that hold such a word.
    """
    marked = messages.select(key, F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("link"))
    said = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    plain, held = looked_up(messages, labels.select("label").where("label <> ''").distinct(), said, "label", key)
    whole = F.concat(F.lit(r"(?U)\b\Q"), "label", F.lit(r"\E\b"))
    longer = held.join(messages.select(key, "text"), key).where(F.regexp_like("text", whole))
    named = plain.unionByName(longer.select(*plain.columns)).select(key, F.col("label").alias("link"))
    return marked.unionByName(named).groupBy(key).agg(F.array_sort(F.collect_set("link")).alias("links"))


def session_name(path: Column) -> Column:
    """The first eight characters of a log's file name."""
    return F.substring(F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"\.[^.]+$", ""), 1, 8)


def pending(rows: DataFrame) -> DataFrame:
    """The proposal of each candidate (ts, session, text, links, tags) as Markdown: adds `entry`."""
    listed = lambda c, flag: F.when(F.size(F.coalesce(c, F.array())) == 0, "(none)").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit(flag), x)), " "))
    strip = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    said = [
        F.concat(F.lit("## ["), F.coalesce("ts", F.lit("unknown")), F.lit("] ["), F.coalesce("session", F.lit("unknown")), F.lit("]")),
        F.concat(F.lit("Suggested note: "), strip(F.substring("text", 1, 200))),
        F.concat(F.lit("Suggested links: "), listed(F.col("links"), "--link ")),
        F.concat(F.lit("Suggested tags: "), listed(F.col("tags"), "--tag ")),
        F.concat(F.lit("Source excerpt: > "), strip(F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit(" ")))),
    ]
    return rows.withColumn("entry", F.concat_ws("\n", *said))


def write_pending(rows: DataFrame, path: str, enabled: bool) -> None:
    """Writes the proposals as text files, if the user has opted in."""
    if not enabled:
        raise PermissionError("capture isn't enabled")
    entries = pending(rows).select("entry")
    if entries.isEmpty():
        entries = rows.sparkSession.createDataFrame([("# Captured Session Notes\n\n_No candidates found._",)], "entry string")
    entries.write.text(path)
