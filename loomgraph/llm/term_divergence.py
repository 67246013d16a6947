"""Source divergence audit: how the terms of each source of a language differ from those of other sources, and of the language.

Terms are counted by length-bucketed packing: terms of up to 8 bytes become one uint64, those of up to 16 bytes two, and the
packed words are radix-sorted (16 bits at a time) and run-counted in numpy; longer terms are sorted as bytes, in buckets by length.
A task works on chunks of texts of a few megabytes and sends on (lang, source, term, occurrences, documents); Spark sums them, keeps
the terms in enough documents of their language, and compares the distributions with add-one smoothing in whole numbers.

A pair's value is a sum over all kept terms. Terms that neither source has all give the same; terms that one has depend on their
count alone, so counts are grouped first; only terms that both have are looked at one by one, as pairs of sources and
never of rows. Occurrences of one language, source or term are summed where they are read, so none is a hot key.

Defined cases: null text, lang and source count as the empty string; a text without terms adds only its group; a text of any
length is one document, read in pieces between terms if it is long; a language without kept terms gives its pairs the value 0 and no terms;
repeated rows are documents of their own; an empty table gives no rows. Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, checkpointed

#: A term is kept if so many documents of its language have it.
MIN_DOCUMENTS = 3
#: Terms reported for a source.
SHOWN_TERMS = 200
#: Probabilities are in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Bytes of text that are sorted at once, about.
CHUNK_BYTES = 4 << 20
#: Groups are broadcast up to so many; beyond that they are joined by a shuffle.
BROADCAST_GROUPS = 20_000

COUNTED = "lang string, source string, term string, n long, d long"
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Upper bounds of the lengths of the buckets of long terms; longer ones are sorted as Python's bytes.
_LONG = (16, 32, 64, 128)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by unsigned keys, the most significant first: least significant digits of 16 bits first."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key[order] >> key.dtype.type(shift)).astype(np.uint16)
            if digit.size and digit.min() != digit.max():
                order = order[np.argsort(digit, kind="stable")]
    return order


def _runs(group: np.ndarray, keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: where each run of equal (group, keys) begins, its length, and the number of its documents."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return begin, np.diff(np.append(begin, len(group))), np.add.reduceat(new_doc.astype(np.int64), begin)


def _packed(at_each: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes [at, at + length) as big-endian words, zeros after them; length is 0 to 8."""
    shift = (8 * (8 - length)).astype(np.uint64)
    word = at_each[np.minimum(at, len(at_each) - 1)].astype(np.uint64)
    return np.where(length > 0, (word >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))


def count_terms(texts: list[bytes], groups: list[int]) -> Iterator[tuple[int, bytes, int, int]]:
    """(group, term, occurrences, documents) of UTF-8 texts; each belongs to a group."""
    joined = np.frombuffer(b"\0".join(texts) + bytes(16), np.uint8).copy()
    joined[(joined >= 65) & (joined <= 90)] |= 32
    letter = ((joined >= 97) & (joined <= 122)) | (joined >= 128)
    edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0))
    begin, length = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    group = np.asarray(groups, np.uint32)[doc]
    # Every position's next eight bytes, as one word.
    at_each = np.ndarray((len(joined) - 7,), dtype=">u8", buffer=joined, strides=(1,))
    for low, high in ((0, 8), (8, 16)):
        short = np.flatnonzero((length > low) & (length <= high))
        if not len(short):
            continue
        at, size = begin[short], length[short]
        words = [_packed(at_each, at + i, np.clip(size - i, 0, 8)) for i in range(0, high, 8)]
        order = radix_order([group[short], *words])
        g, words, d = group[short][order], [w[order] for w in words], doc[short][order]
        first, n, docs = _runs(g, words, d)
        terms = np.ascontiguousarray(np.stack([w[first] for w in words], axis=1).astype(">u8")).view(f"S{high}").ravel()
        yield from zip(g[first].tolist(), terms.tolist(), n.tolist(), docs.tolist(), strict=True)
    whole = joined.tobytes()
    for low, high in zip(_LONG, _LONG[1:], strict=False):
        some = np.flatnonzero((length > low) & (length <= high))
        if len(some):
            terms = np.array([whole[b : b + n] for b, n in zip(begin[some].tolist(), length[some].tolist(), strict=True)], f"S{high}")
            order = np.argsort(terms, kind="stable")
            order = order[radix_order([group[some][order]])]
            g, terms, d = group[some][order], terms[order], doc[some][order]
            first, n, docs = _runs(g, [terms], d)
            yield from zip(g[first].tolist(), terms[first].tolist(), n.tolist(), docs.tolist(), strict=True)
    some = np.flatnonzero(length > _LONG[-1])
    if len(some):
        rows = sorted((int(group[i]), whole[begin[i] : begin[i] + length[i]], int(doc[i])) for i in some)
        counts = Counter((g, t) for g, t, _ in rows)
        docs = Counter((g, t) for g, t, _ in set(rows))
        yield from ((g, t, n, docs[g, t]) for (g, t), n in counts.items())


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of some CHUNK_BYTES that end between terms."""
    at = 0
    while at < len(text):
        found = _BETWEEN.search(text, at + CHUNK_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, text) rows, chunk by chunk."""
    numbers: dict[tuple[str, str], int] = {}
    texts, groups, held = [], [], 0

    def told(rows) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        if rows:
            keys = list(numbers)
            g, terms, n, d = zip(*rows, strict=True)
            text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([keys[x][0] for x in g], pa.string()), pa.array([keys[x][1] for x in g], pa.string()), text(terms), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "d"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            number = numbers.setdefault((lang, source), len(numbers))
            if len(text) > CHUNK_BYTES:
                found = Counter()
                for piece in _pieces(text):
                    for _, term, n, _ in count_terms([piece], [0]):
                        found[term] += n
                yield from told((number, term, n, 1) for term, n in found.items())
                continue
            texts.append(text)
            groups.append(number)
            held += len(text) + 1
            if held >= CHUNK_BYTES:
                yield from told(count_terms(texts, groups))
                texts, groups, held = [], [], 0
    if texts:
        yield from told(count_terms(texts, groups))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of every term in every group of documents."""
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(plain("lang"), plain("source"), plain("text")).mapInArrow(_count, COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact; null if nothing is kept."""
    return F.when(F.expr(f"{kept} > 0"), F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0))) div CAST({total} + {kept} AS DECIMAL(20,0))"))


def gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: part `pair` compares each source with the others of its language, part `term` lists
    the terms that a source has more often than its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    try:
        return checkpointed(_compared(docs, scratch))
    finally:
        scratch.clear()


def _compared(docs: DataFrame, scratch: Scratch) -> DataFrame:
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("uses"))
    kept = scratch.table(by_term.where(F.col("d") >= MIN_DOCUMENTS).drop("d"), "kept")
    used = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("uses"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(plain("lang"), plain("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = checkpointed(groups.withColumn("p0", share("0", "total", "kept")))
    few = groups.count() <= BROADCAST_GROUPS
    near = F.broadcast(groups) if few else groups
    other = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("p0").alias("other_p0"))
    near_other = F.broadcast(other) if few else other

    # Terms of one source alone: what each count adds to the value that two counts of 0 would give, once for the source and once for the other.
    by_count = used.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(near, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    one = by_count.join(near_other, "lang").where("source <> other")
    value = lambda a, b: f"({gap(a, b)})"
    one = one.selectExpr(
        "lang",
        f"inline(array(struct(source, other AS item, m * ({value('p', 'other_p0')} - {value('p0', 'other_p0')}) AS value), struct(other AS source, source AS item, m * ({value('other_p0', 'p')} - {value('other_p0', 'p0')}) AS value)))",
    )
    none = near.join(near_other, "lang").where("source <> other").selectExpr("lang", "source", "other AS item", f"coalesce(kept * {value('p0', 'other_p0')}, 0) AS value")

    # Terms of both: their value, less what the three sums above have given them.
    use = used.join(near, ["lang", "source"]).select("lang", "term", "source", share("n", "total", "kept").alias("p"), "p0")
    uses = use.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("uses")).where(F.size("uses") > 1)
    both = uses.select("lang", "uses", F.explode("uses").alias("x")).select("lang", "x", F.explode("uses").alias("y")).where("x.source <> y.source")
    more = f"{value('x.p', 'y.p')} - {value('x.p', 'y.p0')} - {value('x.p0', 'y.p')} + {value('x.p0', 'y.p0')}"
    both = both.selectExpr("lang", "x.source AS source", "y.source AS item", f"{more} AS value")
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    pairs = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(both).unionByName(none)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = used.join(near, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")}).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN_TERMS)
    return pairs.unionByName(terms)
