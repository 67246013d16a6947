"""Mixing sources to target weights: Efraimidis-Spirakis sampling with word budgets, in DataFrame operations only.

Each source gets a budget of words (its target). Whole epochs come first: every document is taken
floor(target / source size) times. What is left of the budget is filled by a weighted sample without replacement:
a document's key is -ln(u) / quality, u uniform from a hash of its id; documents follow in ascending key, and their
sizes are summed up to the budget. The document at the edge is taken if that brings the sum nearer to the budget.

No source is sorted as a whole: keys are cut into ranges in proportion to the source's rows, the ranges' sums tell in
which one the budget ends, and only that range is sorted row by row. So a source with a third of all rows costs no
task more than others.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own (last in order);
a null id is hashed like an empty text; ties in the key follow doc_id and size, and repeated rows are separate
documents; a source of size 0 has target 0; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD_PATTERN, checkpointed, free_name

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MAX_REPEATS = 3
#: Documents in one range of keys, about.
RANGE_ROWS = 2_000
#: Sources' budgets are broadcast up to so many sources; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of words. Each word with what parts it from the next becomes one sign, so no list of words is made."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.coalesce(F.char_length(F.regexp_replace(trimmed, f"{WORD_PATTERN}[{SEPARATORS}]*", "x")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 if a text has 50 words or more of 2 to 10 characters on average (with one separator each), else 0.5."""
    chars = F.coalesce(F.char_length(text), F.lit(0))
    return F.when((size >= 50) & (chars >= 3 * size) & (chars <= 11 * size), F.lit(1.0)).otherwise(F.lit(0.5))


def sample_key(doc_id: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return -F.ln(uniform) / weight


def budgets(sizes: DataFrame) -> DataFrame:
    """Targets of (source, source_size, n_docs): shares by weight, stopped at MAX_REPEATS times the size, the excess reshared."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * MAX_REPEATS)
    # In order of ceiling per weight the stopped sources come first; the level is what the others get per weight.
    by_ratio = W.orderBy(F.col("ceiling") / F.col("w"), "place")
    before, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stepped = ranked.withColumns(
        {
            "stopped": F.coalesce(F.sum("ceiling").over(before), F.lit(0)),
            "w_left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
            "total": F.sum("source_size").over(whole),
            "step": F.row_number().over(by_ratio),
        }
    ).withColumn("level", (F.col("total") - F.col("stopped")) / F.col("w_left"))
    below = F.col("level") < F.col("ceiling") / F.col("w")
    stepped = stepped.withColumn("first_open", F.min(F.when(below, F.col("step"))).over(whole))
    level = F.max(F.when(F.col("step") == F.col("first_open"), F.col("level"))).over(whole)
    stepped = stepped.withColumn("open_level", level)
    target = F.when(F.col("step") < F.coalesce("first_open", F.lit(2**31 - 1)), F.col("ceiling").cast("double")).otherwise(F.col("w") * F.col("open_level"))
    return stepped.select("source", "source_size", "n_docs", target.alias("target"))


def mix(sized: DataFrame) -> DataFrame:
    """What the mix takes of rows (doc_id, source, size, key): adds source_size, target and taken (words)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = checkpointed(
        budgets(sizes).withColumns(
            {
                "epochs": F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"),
                "ranges": F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long"),
            }
        ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of_source")
    )
    few = plan.count() <= BROADCAST_SOURCES

    def joined(rows: DataFrame, right: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")

    cut = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1).cast("long")
    rows = joined(sized, plan.select("of_source", "source_size", "target", "epochs", "rest", "ranges")).withColumn("range", cut)
    sums = rows.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("range")
    ends = (
        sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where("before <= rest")
        .groupBy(F.col("source").alias("of_source"))
        .agg(F.max("range").alias("last_range"), F.max_by("before", "range").alias("before"))
    )
    rows = joined(rows, checkpointed(ends))
    taken = lambda more: (F.col("size") * (F.col("epochs") + more)).cast("long").alias("taken")
    base = ["doc_id", "source", "size", "source_size", "target"]
    clear = rows.where("range <> last_range").select(*base, taken(F.when(F.col("range") < F.col("last_range"), 1).otherwise(0)))
    inside = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.where("range = last_range").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    edge = edge.select(*base, taken(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)))
    return clear.unionByName(edge)


def sized(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, source, size, key) that mix() works on, computed once."""
    size = docs.select("doc_id", "source", "text", words(F.col("text")).alias("size"))
    keyed = size.select("doc_id", "source", "size", sample_key(F.col("doc_id"), quality(F.col("text"), F.col("size"))).alias("key"))
    return checkpointed(keyed)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of `docs`."""
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as it is taken. Rows of size 0 carry no words and stay out.

    Rows with the same doc_id and size can't be told apart by the mix: together they get what it takes of them.
    """
    repeats = mix_documents(docs).where("taken > 0").select("doc_id", "size", (F.col("taken") / F.col("size")).cast("long").alias("times"))
    size, rank, times, of_id, of_size = (free_name(docs, x) for x in ("mix_size", "mix_rank", "mix_times", "of_id", "of_size"))
    taken = repeats.groupBy(F.col("doc_id").alias(of_id), F.col("size").alias(of_size)).agg(F.sum("times").alias(times))
    same = W.partitionBy("doc_id", size).orderBy(F.xxhash64("text"))
    rows = docs.withColumn(size, words(F.col("text"))).join(taken, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(size) == F.col(of_size)))
    rows = rows.withColumn(rank, F.row_number().over(same)).withColumn(size, F.count("*").over(W.partitionBy("doc_id", size)))
    copies = F.floor(F.col(times) / F.col(size)) + F.when(F.col(rank) <= F.col(times) % F.col(size), 1).otherwise(0)
    return rows.withColumn(rank, F.explode(F.sequence(F.lit(0), copies.cast("int")))).where(F.col(rank) > 0).select(*docs.columns)
