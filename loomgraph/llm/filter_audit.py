"""Filter interaction audit: what each filter of a cleaning chain removes, in every order of the filters.

Every document gets a mask, one bit for each filter that it fails; a part (a language, say) is then no more than its counts of
documents, good and toxic ones by mask. What a subset of filters leaves is told by a Gray-code walk over all subsets: each
step switches one filter on or off, the mask cells that hold its bit count one active failure more or less, and a cell
whose count leaves or reaches 0 leaves or joins the running survivors. All states are stored (32 for five filters), and the
step of an order is the difference of two of them.

Work by rows: one reading of the texts gives (doc_id, part, mask, digest); the last filter, an equal text with a smaller
doc_id, is an aggregation by digest and a join on (digest, doc_id), so the copies of one text are never in one task. All that
a part's walk gets is at most one row for each mask.

Defined cases: null text counts as the empty text, a null part as the empty string; null doc_ids come after all others (they
fail the last filter if an equal text has an id, and have no label); rows that share the smallest id of a text all pass;
several labels of a doc_id count as good or toxic if one of them says so; an empty table gives no rows. Other columns
of `docs` and `labels` aren't looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD_PATTERN, checkpointed
from .mixing import words

MIN_WORDS = 200
MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 3
SIGNS = "[#$%&*|]"
#: Subsets and orders are listed, so there must be few filters.
MOST_FILTERS = 8

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters on a text alone: name and condition of failure. `text` isn't null."""
    n_words = words(text)
    distinct = F.size(F.array_distinct(F.split(F.btrim(text, F.lit(SEPARATORS)), f"[{SEPARATORS}]+")))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < MIN_WORDS,
        "B": (n_words > 0) & (100 * distinct < MIN_DISTINCT_PERCENT * n_words),
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.char_length(text),
        "D": text.rlike(SIGNS),
    }


def masks(docs: DataFrame, part: Column, filters: dict[str, Column]) -> DataFrame:
    """(doc_id, part, mask, n): rows by id and mask; bit i is set if filter i fails, the bit after the last for a later copy of a text."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = F.lit(0)
    for bit in bits:
        mask = mask + bit
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = checkpointed(rows)
    first = rows.groupBy(F.col("digest").alias("of_digest")).agg(F.min("doc_id").alias("first_id"))
    # Repeated rows become one before the join, so that its keys are never hot.
    own = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    met = own.join(first, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    later = F.when(F.col("of_digest").isNull(), 1 << len(filters)).otherwise(0)
    return met.select("doc_id", "part", (F.col("mask") + later).alias("mask"), "n").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents."""
    is_one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = masked.join(judged, "doc_id", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def survivors(counts: np.ndarray, n_filters: int) -> np.ndarray:
    """For each subset of filters (a bit set) the sums over cells that fail none of it: counts is (kinds, cells), the result (kinds, subsets)."""
    cell = np.arange(1 << n_filters)
    failing = np.zeros(1 << n_filters, np.int64)
    running = counts.sum(axis=1)
    states = np.empty_like(counts)
    active = 0
    states[:, 0] = running
    for step in range(1, 1 << n_filters):
        turned = (step & -step).bit_length() - 1
        active ^= 1 << turned
        touched = cell[cell >> turned & 1 == 1]
        if active >> turned & 1:
            running = running - counts[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        states[:, active] = running
    return states


def steps(part: str, counts: np.ndarray, names: str) -> list[tuple]:
    """The rows of one part, from (documents, good, toxic) by mask."""
    states = survivors(counts, len(names))
    bit = {name: 1 << i for i, name in enumerate(names)}
    fails = {name: int(states[0, 0] - states[0, bit[name]]) for name in names}
    rows, removed_in_all = [], dict.fromkeys(names, 0)
    for order in permutations(names):
        before = 0
        for i, name in enumerate(order, 1):
            after = before | bit[name]
            removed, good, toxic = (states[:, before] - states[:, after]).tolist()
            removed_in_all[name] += removed
            rows.append(("".join(order), i, int(states[0, after]), removed, fails[name] - removed, int(counts[0, bit[name]]), good, toxic))
            before = after
    return [(part, *row, removed_in_all[row[0][row[1] - 1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """For each part, order of filters and step: what is kept and removed there, and what of it is labelled good or toxic.

    `filters` names conditions of failure over columns of `docs` (one letter each, five of them make 120 orders); `copies`
    names the filter against later copies of a text. `shapley` is a filter's removals summed over all orders.
    """
    filters = text_filters(F.coalesce("text", F.lit(""))) if filters is None else filters
    names = "".join([*filters, copies])
    if len(set(names)) != len(filters) + 1 or len(names) > MOST_FILTERS:
        raise ValueError(f"filters need different names of one letter each, {MOST_FILTERS} at most")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 1 << len(names)), np.int64)
        counts[:, rows["mask"].to_numpy()] = rows[["n", "good", "toxic"]].to_numpy(np.int64).T
        return pd.DataFrame(steps(key[0], counts, names), columns=[c.split()[0] for c in RESULT.split(", ")])

    return cells(masks(docs, part, filters), labels).groupBy("part").applyInPandas(walk, RESULT)
