"""Mentions of code entities in texts, as a join on words instead of one large pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from .paths import stored

WORD = r"[\p{L}\p{N}_]+"
MIN_NAME = 3


def entity_names(nodes: DataFrame) -> DataFrame:
    """name -> id of code entities: lower-case labels without brackets, three characters or more; of equal names the last."""
    name = F.lower(F.regexp_replace("label", r"^[()]+|[()]+$", ""))
    rows = nodes.where("file_type = 'code'").withColumn("name", name).where((F.length("name") >= MIN_NAME) & ~F.col("label").startswith("."))
    rows = rows.where(F.col("label") != file_name(F.coalesce("source_file", F.lit(""))))
    return rows.groupBy("name").agg(F.max_by("id", "ord").alias("id"))


def words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def by_rarest_word(names: DataFrame, column: str) -> DataFrame:
    """Names of one word and others with the word that they are looked up by: of a name's words the one that fewest names hold. Names without
    a word go. Adds word, and `plain`: the name is that word."""
    own = F.array_distinct(F.regexp_extract_all(column, F.lit(WORD), F.lit(0)))
    rows = names.select("*", F.explode(own).alias("word"))
    shared = rows.groupBy("word").agg(F.count("*").alias("names"))
    rest = [c for c in names.columns if c != column]
    best = rows.join(shared, "word").groupBy(column, *rest).agg(F.min_by("word", F.struct("names", "word")).alias("word"))
    return best.select("*", (F.col(column) == F.col("word")).alias("plain"))


def looked_up(texts: DataFrame, names: DataFrame, said: Column, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key and names' columns) of plain names that a text's words hold, and of others of which they hold the rarest word. Texts aren't shuffled with
    their words: names are stored, so that Spark knows whether they are few enough to be sent to all tasks, and so are the hits."""
    known = stored(by_rarest_word(names, column), "names")
    hits = stored(texts.select(key, F.explode(said).alias("word")).join(known, "word").drop("word"), "hits")
    return hits.where("plain").drop("plain"), stored(hits.where("not plain").drop("plain"), "held")


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(source_id of the document, id of the entity), one row for each pair. `docs` has source_id and text.

    Names made of word characters join on words. Other names (`a.b`, `x::y`) are rare: each is looked up by one of the words it is made of,
    and the whole name is then found between word boundaries in the texts that hold this word. A text's words within such a
    longer name don't count as mentions of the shorter one.
    """
    plain, held = looked_up(docs, names, words(F.col("text")), "name", "source_id")
    if held.isEmpty():
        return plain.select("source_id", "id").distinct()
    quoted = lambda n: F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))
    found = held.join(docs.select("source_id", "text"), "source_id").where(F.regexp_like(F.lower("text"), quoted(F.col("name"))))
    found = stored(found.select("source_id", "name", "id").distinct(), "found")
    longer = found.groupBy("source_id").agg(F.collect_set("name").alias("full"))
    strip = lambda t, names: F.aggregate(F.array_sort(names, lambda a, b: F.length(b) - F.length(a)), F.lower(t), lambda s, n: F.regexp_replace(s, quoted(n), " "))
    rest = docs.join(longer, "source_id").select("source_id", F.explode(words(strip(F.col("text"), F.col("full")))).alias("name"))
    masked = rest.join(names.where(F.col("name").rlike(f"^{WORD}$")), "name").select("source_id", "id")
    untouched = plain.select("source_id", "id").join(longer, "source_id", "left_anti")
    return untouched.unionByName(masked).unionByName(found.select("source_id", "id")).distinct()


def cross_reference(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """`mentions` edges from documents to code: texts are (source_file, text); a file's first document node stands for it."""
    heads = nodes.where("file_type in ('document', 'paper') and source_file <> ''").groupBy("source_file").agg(F.min_by("id", "ord").alias("source_id"))
    said = mentions(texts.select(F.col("source_file").alias("source_id"), "text"), entity_names(nodes)).withColumnRenamed("source_id", "source_file")
    pairs = said.join(heads, "source_file").where("source_id <> id")
    return pairs.select(F.col("source_id").alias("source"), F.col("id").alias("target"), F.lit("mentions").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(False).alias("directed"))
