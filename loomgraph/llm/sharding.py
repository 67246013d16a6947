"""Sharding by sampled splitters, in DataFrame operations only: shards of nearly equal bytes that keep equal texts together.

Rows are ordered by (hash of the text, hash of the id, place in the input), so equal texts are neighbours. Ranges of this order are
made by sampling: rows are drawn with a chance in proportion to their size, the sample's quantiles become splitters, and a row finds
its range by a binary search among them; what equals a splitter is a range of its own. Ranges that turn out overfull are subdivided
in the same way, first between texts, then, where one text alone is too much, between its copies. Each range goes whole
to one shard, in order, by where the middle of its bytes falls. A record's slot is the number of records before it in its shard.

No task sorts more than one range. Splitters are broadcast: there are at most 3 * MOST_RANGES of them, whatever the input.
The keys are written to a table in the shared folder with the rows, so that every pass sees the same places, lost executors or not.

Defined cases: null and empty texts have size 1 and are equal; null ids are like any other id; repeated rows are records of
their own, with a slot each; a record larger than a range may be is a range of its own; an empty input gives an empty result, and
shards may stay empty if there are few records. Columns of any name are kept; the result's column is the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, free_name, shared_table

SHARDS = 8
#: Ranges that the first splitters aim at, for each shard.
RANGES_A_SHARD = 256
#: Sampled keys for each range.
SAMPLES_A_RANGE = 16
#: A range with more bytes than this, or more than twice its share, is overfull.
RANGE_BYTES = 256 << 20
#: Beyond so many ranges they grow instead.
MOST_RANGES = 200_000
#: A range is split into so many at once, at most.
MOST_PIECES = 2048
#: Subdivisions of subdivisions; what is overfull after so many stays so, which costs balance and no rows.
LEVELS = 5


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _search(splitters: Column, key: Column) -> Column:
    """Twice the number of splitters below `key`, and one more if it equals the next; splitters are sorted and distinct."""
    halves = F.array(*[F.lit(MOST_PIECES >> i) for i in range(MOST_PIECES.bit_length())])
    below = F.aggregate(halves, F.lit(0), lambda low, half: F.when(F.get(splitters, low + half - 1) < key, low + half).otherwise(low))
    return (2 * below + F.when(F.get(splitters, below) == key, 1).otherwise(0)).cast("long")


def _key(by_copy: Column) -> Column:
    """What splitters are compared with: the text alone, or also the copy."""
    return F.struct(F.col("k.text").alias("text"), F.when(by_copy, F.col("k.id")).otherwise(0).alias("id"), F.when(by_copy, F.col("k.place")).otherwise(0).alias("place"))


#: Range numbers of the next level for each range of this one.
STRIDE = 2 * MOST_PIECES + 2


def _divided(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """`rows` (range, k, ...) with the numbers of their subranges; ranges that `splitters` doesn't name stay whole."""
    met = rows.join(F.broadcast(splitters), F.col("range") == F.col("of_range"), "left")
    sub = F.when(F.col("of_range").isNotNull(), _search(F.col("splitters"), _key(F.col("by_copy")))).otherwise(F.lit(0).cast("long"))
    return met.withColumn("range", F.col("range") * STRIDE + sub).drop("of_range", "by_copy", "splitters")


def _splitters(rows: DataFrame, overfull: DataFrame) -> DataFrame:
    """(of_range, by_copy, splitters) from a sample of each overfull range (of_range, bytes, pieces, by_copy), drawn by size."""
    uniform = (F.xxhash64("k.place", "k.id", "range") / F.lit(2.0**64)) + 0.5
    met = rows.join(F.broadcast(overfull), F.col("range") == F.col("of_range"))
    drawn = met.withColumn("draws", F.floor(F.col("k.size") * F.col("pieces") * SAMPLES_A_RANGE / F.col("bytes") + uniform).cast("int")).where("draws > 0")
    drawn = drawn.select("of_range", "by_copy", "pieces", _key(F.col("by_copy")).alias("key"), F.explode(F.sequence(F.lit(1), "draws")))
    sample = drawn.groupBy("of_range", "by_copy", "pieces").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    nth = lambda i: F.get("keys", F.floor(i * F.size("keys") / F.col("pieces")).cast("int"))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("pieces") - 1, F.lit(1))), nth))
    return sample.select("of_range", "by_copy", F.array_compact(chosen).alias("splitters"))


def _totals(rows: DataFrame) -> DataFrame:
    text, copy = F.col("k.text"), F.struct("k.id", "k.place")
    return rows.groupBy("range").agg(F.sum("k.size").alias("bytes"), F.count("*").alias("n"), (F.min(text) < F.max(text)).alias("texts"), (F.min(copy) < F.max(copy)).alias("copies"))


def _ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """`rows` with range numbers that follow the order, (range, bytes, n) of all ranges, and the stride of the first level's numbers."""
    rows, level = rows.withColumn("range", F.lit(0).cast("long")), 0
    totals = checkpointed(_totals(rows))
    whole = totals.agg(F.sum("bytes")).first()[0] or 0
    most = max(whole // MOST_RANGES, min(2 * whole // (SHARDS * RANGES_A_SHARD), RANGE_BYTES), 1)
    while level < LEVELS:
        overfull = totals.where((F.col("bytes") > most) & (F.col("texts") | F.col("copies")))
        pieces = F.least(F.ceil(2 * F.col("bytes") / most), F.lit(MOST_PIECES)).cast("int")
        overfull = checkpointed(overfull.select(F.col("range").alias("of_range"), "bytes", pieces.alias("pieces"), (~F.col("texts")).alias("by_copy")))
        if overfull.isEmpty():
            break
        rows = _divided(rows, checkpointed(_splitters(rows, overfull)))
        totals, level = checkpointed(_totals(rows)), level + 1
    return rows, totals.select("range", "bytes", "n"), STRIDE ** max(level - 1, 0)


def _placed(ranges: DataFrame, stride: int) -> DataFrame:
    """(range, shard, before): the shard of each range, and the records before it in that shard. Sums run first over the ranges of
    the first level (at most STRIDE), then within each."""
    coarse = F.floor(F.col("range") / stride).alias("coarse")
    ranges = ranges.withColumn("coarse", coarse)
    heads = ranges.groupBy(F.col("coarse").alias("of_coarse")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    earlier, everything = W.orderBy("of_coarse").rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    or_none = lambda c: F.coalesce(c, F.lit(0))
    heads = heads.select("of_coarse", or_none(F.sum("bytes").over(earlier)).alias("bytes_to"), or_none(F.sum("n").over(earlier)).alias("n_to"), F.sum("bytes").over(everything).alias("whole"))
    within = W.partitionBy("coarse").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    met = ranges.join(F.broadcast(heads), F.col("coarse") == F.col("of_coarse"))
    at = F.col("bytes_to") + or_none(F.sum("bytes").over(within))
    shard = F.floor((2 * at + F.col("bytes")) * SHARDS / (2 * F.col("whole")))
    met = met.select("range", F.least(shard, F.lit(SHARDS - 1)).cast("int").alias("shard"), (F.col("n_to") + or_none(F.sum("n").over(within))).alias("before"))
    first = met.groupBy(F.col("shard").alias("of_shard")).agg(F.min("before").alias("first"))
    return met.join(F.broadcast(first), F.col("shard") == F.col("of_shard")).select("range", "shard", (F.col("before") - F.col("first")).alias("before"))


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, and a last column `sharded` (under another name where `docs` has it): struct of size, shard
    and slot. Sizes of the shards are nearly equal: they differ by a range or a record."""
    sharded = free_name(docs, "sharded")
    key = F.struct(
        _size(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("id"), F.monotonically_increasing_id().alias("place")
    )
    packed = shared_table(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("k")), "shard-keys")
    rows, ranges, stride = _ranges(packed)
    # The divisions so far read the keys alone; now whole rows go through them, to be shuffled once.
    met = rows.join(checkpointed(_placed(ranges, stride)), "range")
    inside = W.partitionBy("range").orderBy("k.text", "k.id", "k.place")
    slot = (F.col("before") + F.row_number().over(inside) - 1).cast("long")
    return met.select("row.*", F.struct(F.col("k.size").alias("size"), "shard", slot.alias("slot")).alias(sharded))


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """The shards as Parquet in folders `shard=<number>`; rows follow their slot within a file, and files in the order of their names."""
    found = shards(docs, doc_id, text)
    last = found.columns[-1]
    kept = found.select(*docs.columns, F.col(f"{last}.shard").alias(free_name(docs, "shard")), F.col(f"{last}.slot").alias(free_name(docs, "slot")))
    shard, slot = kept.columns[-2:]
    kept.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
