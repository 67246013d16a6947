"""SimHash near-duplicate classes, candidates by pigeonring filtering.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles. Two fingerprints
link if they differ in at most `TAU` bits. The 64 bits form a ring of `SEGMENTS` segments. If two fingerprints
differ in at most TAU bits, then some start on the ring has a chain of consecutive segments whose cumulative
differences stay within the proportional budgets TAU * length / SEGMENTS at every length (the strong form of
the pigeonhole principle on a ring). With 9 segments and 2 bits the budgets are 0 for lengths 1 to 4, 1 for
lengths 5 to 8 and 2 for 9. So four consecutive equal segments (28 bits) are an equi-join key, lengths 5 to 8
prune its matches, and the full Hamming distance decides.

Buckets of a key with more than `PAIR_BUCKET` fingerprints (families of near copies) aren't paired: there each
fingerprint is sent to itself and to its neighbours at one bit's distance. Two of a bucket differ in at most two
bits if and only if they share such a neighbour, so linking each to the smallest with the same neighbour loses no
connection and makes no quadratic number of rows.

Nulls and empty texts have the fingerprint zero and link like others. Repeated rows, ties: a class is named by
its smallest doc_id. Rows without doc_id keep a fingerprint and get their class's id (null if no row of the class
has one). Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHINGLE = 3
TAU = 2
SEGMENTS = 9
CHAIN = 4
PAIR_BUCKET = 64
#: Edges that one task settles in memory.
EDGES_A_TASK = 200_000
#: First bit of each segment on the ring, counted from the high end; the last segment has 8 bits.
STARTS = [7 * i for i in range(SEGMENTS)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's lower-cased word shingles."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    data = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(data, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [digest(data[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes) -> int:
    """The bits that over half the hashes set, as a signed number."""
    import numpy as np

    total, bits = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65_536):
        block = hashes[at : at + 65_536].astype(">u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total).view(">i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return run(text)


def _rotated(value: Column, bits: int) -> Column:
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def _length(start: int, segments: int) -> int:
    """Bits in so many segments of the ring from a segment on."""
    return sum(8 if (start + j) % SEGMENTS == SEGMENTS - 1 else 7 for j in range(segments))


def _chain_mask(start: int, segments: int) -> int:
    """Signed mask of the bits, rotated to the top, of a chain."""
    n = _length(start, segments)
    return ((1 << n) - 1 << 64 - n) - (1 << 64)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`: each pair within TAU bits is connected by them."""
    keys = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), s).alias("ring")) for i, s in enumerate(STARTS)])).alias("k"),
    ).select("fp", "k.start", "k.ring")
    narrow = [F.shiftrightunsigned("ring", 64 - _length(i, CHAIN)) for i in range(SEGMENTS)]
    key = F.when(F.col("start") == 0, narrow[0])
    for i in range(1, SEGMENTS):
        key = key.when(F.col("start") == i, narrow[i])
    keys = keys.withColumn("key", key)
    sizes = keys.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    keys = checkpointed(keys.join(sizes, ["start", "key"]))

    paired = keys.where(F.col("n") <= PAIR_BUCKET).select("start", "key", "fp", "ring")
    other = paired.select("start", "key", F.col("fp").alias("fp2"), F.col("ring").alias("ring2"))
    differ = F.col("ring").bitwiseXOR(F.col("ring2"))
    chain = F.when(F.col("start") == 0, F.lit(_chain_mask(0, 2 * CHAIN)))
    for i in range(1, SEGMENTS):
        chain = chain.when(F.col("start") == i, F.lit(_chain_mask(i, 2 * CHAIN)))
    within_budget = F.bit_count(differ.bitwiseAND(chain)) <= 1
    pairs = (
        paired.join(other, ["start", "key"])
        .where((F.col("fp") < F.col("fp2")) & within_budget & (F.bit_count(differ) <= TAU))
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )

    free = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64 - CHAIN * 7)]]
    around = keys.where(F.col("n") > PAIR_BUCKET).select(
        "start", "key", "fp", F.explode(F.transform(F.array(*free), lambda m: F.col("ring").bitwiseXOR(m))).alias("near")
    )
    least = around.groupBy("start", "key", "near").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1")
    stars = around.join(least, ["start", "key", "near"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def settled(a, b):
    """The nodes of the edges (a[i], b[i]) and the smallest node that each reaches."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        one, other = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _settled_by_task(edges: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each task ties those of its at most EDGES_A_TASK edges to their smallest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            nodes, roots = settled(*(pd.concat(parts)[c].to_numpy() for c in ("a", "b")))
            yield pd.DataFrame({"a": nodes, "b": roots})[nodes != roots]

    return edges.coalesce(-(-count // EDGES_A_TASK)).mapInPandas(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (a, b), both long. Nodes without an edge aren't listed.

    Tasks first settle the edges that they hold, so few edges need one task and no shuffle. What several tasks hold goes through
    alternating large-star and small-star rounds; each ends in a checkpoint, and no round keeps a node's
    neighbours together in memory.
    """

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = checkpointed(df.distinct())
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(row)

    named = lambda df: df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges, state = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    if 0 < state[0] <= EDGES_A_TASK:
        return named(checkpointed(_settled_by_task(edges, state[0])))
    if state[0]:
        edges, state = settle(_settled_by_task(edges, state[0]))
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(root, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        before = state
        edges, state = settle(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return named(edges)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) of distinct fingerprints `fp`: root is the smallest one that links of at most TAU bits reach."""
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id."""
    prints = checkpointed(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = distinct.join(classes(distinct.select("fp")), "fp")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
