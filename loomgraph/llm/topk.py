"""Exact top-k inner products by norm-bucketed retrieval.

Components become integers first. Vectors are ordered by length and cut into blocks of about `BLOCK` rows, so a block
holds vectors of like length. Each query gets a lower bound first: the k-th best score within the block of the
longest vectors. In each block the bound becomes a local cosine threshold: bound / (query's length * longest of the block).
At a threshold above 1 the whole block is pruned by length. From `COORDINATE_FROM` up, candidates are pruned by
coordinate: in each of the query's largest coordinates the unit vector must lie in the interval that the threshold
leaves. Below that, they are pruned by their own length. What remains is verified by exact integer products.

Work is dealt out as pairs of a query block and a vector block, each of bounded size. A block's length and the least bound of a
query block decide before anything is shipped whether the two must meet (`meetings`); vectors go to no other. Vectors that are
null, or hold null or non-finite components, take no part; vectors are compared with those of the same dimension only. Rows
that share a vec_id are all candidates, each query row has a result of its own, and only that row itself is left out. Rows
without vec_id take no part. Zero vectors score 0. Ties go to the smaller vec_id. Other columns aren't read. Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

K = 5
BLOCK = 4_096
QUERY_BLOCK = 1_024
SCALE = 256
COORDINATE_FROM = 0.5
COORDINATES = 3
#: Slack for lengths and cosines in floating point; products are integers.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, vec, norm2): integer components of each row that takes part; `row` numbers them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.where("embedding is not null and vec_id is not null").where(finite).select("vec_id", whole.alias("vec"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, dim, ids, rows, flat, longest): rows in order of length, cut into blocks of at most `size` rows."""
    parts = max(1, -(-rows.count() // size))
    ordered = rows.repartitionByRange(parts, F.col("norm2").desc(), "vec_id", "row").withColumn("at", F.monotonically_increasing_id())
    placed = checkpointed(ordered.withColumn("part", F.shiftright("at", 33)))
    # One row for each part: where it starts in the whole order.
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    cut = placed.join(starts, "part").withColumn("cut", F.floor(rank / size)).withColumn("dim", F.size("vec"))
    grouped = cut.groupBy("dim", "cut").agg(F.collect_list(F.struct("vec_id", "row", "vec")).alias("all"), F.max("norm2").alias("longest"))
    blocks = checkpointed(grouped.select("dim", "cut", "longest", F.col("all.vec_id").alias("ids"), F.col("all.row").alias("rows"), F.flatten("all.vec").alias("flat")))
    # Blocks are few, one for thousands of vectors; their numbers are given without the vectors.
    numbers = blocks.select("dim", "cut").withColumn("block", F.row_number().over(W.partitionBy("dim").orderBy("cut")) - 1)
    return checkpointed(blocks.join(numbers, ["dim", "cut"]).drop("cut"))


def best_of_block(queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, longest: float, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query's row, rows of the vectors that may be among its best k), pruned by the query's bound."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    unit = vectors / np.maximum(norms, 1)[:, None]
    qnorms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    for i, bound in enumerate(bounds):
        if np.isnan(bound) or qnorms[i] == 0 or bound <= 0:
            yield i, np.arange(len(vectors))
            continue
        local = bound / (qnorms[i] * longest) if longest else 2.0
        if local > 1 + SLACK:
            continue
        if local >= COORDINATE_FROM:
            # A unit vector with cosine >= t to the unit query q has each coordinate within t*q_f +- sqrt((1-t^2)(1-q_f^2)).
            q = queries[i] / qnorms[i]
            keep = np.ones(len(vectors), dtype=bool)
            for f in np.argsort(-np.abs(q))[:COORDINATES]:
                t = min(local, 1.0)
                spread = np.sqrt((1 - t * t) * max(0.0, 1 - q[f] * q[f]))
                # The least cosine is t, a larger one moves the interval towards q_f: its outer ends are these.
                low = t * q[f] - spread if q[f] > -t else -1.0
                high = t * q[f] + spread if q[f] < t else 1.0
                keep &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
            yield i, np.flatnonzero(keep)
        else:
            yield i, np.flatnonzero(norms * qnorms[i] >= bound - SLACK * bound)


def meetings(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_block, dim, block): blocks that may hold one of the best of some query of a query block. Only lengths are joined."""
    reach = asked.select("query_block", "dim", "reach").alias("q")
    lengths = blocks.select("block", "dim", "longest").alias("b")
    near = F.sqrt("b.longest") >= F.col("q.reach") * (1 - SLACK)
    return reach.join(lengths, (F.col("q.dim") == F.col("b.dim")) & near).select("query_block", "q.dim", "block")


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query with all rows but its own."""
    whole = checkpointed(integer_vectors(vectors))
    blocks = _blocks(whole, BLOCK)
    asked = _blocks(whole.where(is_query), QUERY_BLOCK)
    asked = asked.select(F.col("block").alias("query_block"), "dim", *[F.col(c).alias(f"query_{c}") for c in ("ids", "rows", "flat")])

    def matrix(flat, rows: int) -> np.ndarray:
        return np.asarray(flat, dtype=np.float64).reshape(rows, len(flat) // rows)

    def first(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in left.itertuples():
            queries = matrix(q.query_flat, len(q.query_ids))
            bounds = np.full(len(q.query_ids), np.nan)
            for b in right.itertuples():
                scores = queries @ matrix(b.flat, len(b.ids)).T
                scores[np.asarray(q.query_rows)[:, None] == np.asarray(b.rows)[None]] = -np.inf
                if scores.shape[1] > k:
                    bounds = np.partition(scores, -k, axis=1)[:, -k]
            bounds = np.where(np.isfinite(bounds), bounds, np.nan)
            lengths = np.sqrt((queries**2).sum(axis=1))
            # The shortest vector that can still reach some query's bound; without a bound above 0 any can.
            open_ = np.isnan(bounds) | (bounds <= 0) | (lengths == 0)
            reach = np.where(open_, 0.0, bounds / np.maximum(lengths, 1e-300)).min()
            out.append((q.query_block, q.dim, q.query_ids, q.query_rows, q.query_flat, bounds, reach))
        return pd.DataFrame(out, columns=["query_block", "dim", "query_ids", "query_rows", "query_flat", "bounds", "reach"])

    def pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in left.itertuples():
            queries, query_ids, query_rows = matrix(q.query_flat, len(q.query_ids)), np.asarray(q.query_ids), np.asarray(q.query_rows)
            for b in right.itertuples():
                vectors, ids, own = matrix(b.flat, len(b.ids)), np.asarray(b.ids), np.asarray(b.rows)
                for i, at in best_of_block(queries, np.asarray(q.bounds, dtype=float), vectors, float(np.sqrt(b.longest)), k):
                    at = at[own[at] != query_rows[i]]
                    scores = vectors[at] @ queries[i]
                    best = np.lexsort((own[at], ids[at], -scores))[:k]
                    out += [(query_ids[i], query_rows[i], ids[at[j]], own[at[j]], int(scores[j])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "row", "score"])

    bounded = "query_block int, dim int, query_ids array<long>, query_rows array<long>, query_flat array<long>, bounds array<double>, reach double"
    asking = asked.select(F.col("dim").alias("for_dim"), F.col("query_block").alias("for_block"))
    seeds = blocks.where("block = 0").join(asking, F.col("dim") == F.col("for_dim"))
    with_bounds = checkpointed(asked.groupBy("query_block", "dim").cogroup(seeds.groupBy("for_block", "for_dim")).applyInPandas(first, bounded))

    met = checkpointed(meetings(with_bounds, blocks))
    every = with_bounds.join(met, ["query_block", "dim"])
    spread = blocks.join(met.select(F.col("query_block").alias("for_block"), F.col("dim").alias("for_dim"), F.col("block").alias("met")), (F.col("met") == F.col("block")) & (F.col("dim") == F.col("for_dim")))
    found = every.groupBy("query_block", "dim", "block").cogroup(spread.groupBy("for_block", "for_dim", "met")).applyInPandas(pair, "query_id long, query_row long, vec_id long, row long, score long")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
