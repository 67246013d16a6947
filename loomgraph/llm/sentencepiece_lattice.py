"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units where no piece can span (see `runs_of` and `units_of`): the vocabulary proves it. The units that make up most of a
corpus are encoded relationally:

1. explode their substrings of at most the longest piece's length,
2. equi-join them to the piece table, which gives the lattice's edges,
3. group the edges by unit,
4. fold them with Spark's higher-order `aggregate`.

Two folds fit the two kinds of model. `viterbi` finds the best path of a unigram model: the highest sum of scores. A
BPE model isn't defined by a best path (its scores are ranks of merges), so Viterbi would give other pieces than the
library; for it `merges` folds the same lattice by joining the adjacent pair whose edge ranks best, leftmost
first, until none is left. Characters without a piece become byte pieces.

Sending every rare unit through the lattice and back to its documents moves more data than the limits allow (README). So at most
`MAX_FREQUENT` units, the commonest, take that way; their ids have a fixed bound and go to every task. All
other units are folded in the task that meets them, by the same rule over the same edges, looked up as the fold asks for them.
Which units are common changes no result, and every unit of every text is encoded.

Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded alike. Units of any length are
encoded whole. Empty input: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "▁"
MAX_UNIT = 48
#: Units that the lattice encodes at most, and how often one must occur in a task's rows to count as common.
MAX_FREQUENT, LEAST_COUNT = 65_536, 8
#: Ids in one Arrow batch of results, about.
BATCH_IDS = 2_000_000
#: Units that a task remembers at most.
REMEMBERED = 400_000
#: Rank of what is no edge.
NONE = 2**31 - 1


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary: pieces with ids and scores, and the id of the byte piece 0x00."""

    rows: list[tuple[str, int, float]]
    first_byte: int
    longest: int
    inner: frozenset[str]  # pairs of characters that some piece holds side by side

    @classmethod
    def of_model(cls, model_file: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if any(m.get_score(i) % 1 for i in range(m.vocab_size())):
            raise ValueError("not a BPE model: its scores aren't ranks of merges")
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        return cls.of_rows([(m.id_to_piece(i), i, m.get_score(i)) for i in range(m.vocab_size()) if not special(i)], m.piece_to_id("<0x00>"))

    @classmethod
    def of_rows(cls, rows: list[tuple[str, int, float]], first_byte: int) -> Pieces:
        inner = frozenset(p[i : i + 2] for p, _, _ in rows for i in range(len(p) - 1))
        return cls(rows, first_byte, max(len(p) for p, _, _ in rows), inner)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank): rank orders by score, equal scores share a rank."""
        places = {s: i for i, s in enumerate(sorted({s for _, _, s in self.rows}, reverse=True))}
        return spark.createDataFrame([(p, i, float(s), places[s]) for p, i, s in self.rows], "piece string, id int, score double, rank int")


RUN = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def runs_of(text: str) -> list[str]:
    """A text cut before blanks and around line feeds, where no piece spans; a blank is put first, as the library does."""
    return RUN.findall(BLANK + text.replace(" ", BLANK))


def units_of(run: str, pieces: Pieces) -> list[str]:
    """A run itself, or a long one cut between characters that no piece holds side by side."""
    if len(run) <= MAX_UNIT:
        return [run]
    cuts = [0, *(i for i in range(1, len(run)) if run[i - 1 : i + 1] not in pieces.inner), len(run)]
    return [run[a:b] for a, b in zip(cuts, cuts[1:])]


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """Edges of each distinct `unit`, grouped: unit, edges (start, end, id, score, rank); a character that is no piece has no id."""
    size = F.char_length("unit")
    begins = units.select("unit", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    spans = begins.select("unit", "start", F.explode(F.sequence(F.col("start"), F.least(size, F.col("start") + pieces.longest - 1))).alias("end"))
    parts = spans.select("unit", "start", "end", F.substring(F.col("unit"), F.col("start"), F.col("end") - F.col("start") + 1).alias("piece"))
    # The vocabulary has a fixed size, whatever the corpus.
    edges = parts.join(F.broadcast(pieces.table(units.sparkSession)), "piece", "left").where("id is not null or start = end")
    return edges.groupBy("unit").agg(F.collect_list(F.struct("start", "end", "id", "score", "rank")).alias("edges"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(start: Column, end: Column) -> Column:
    return start * 64 + end


def merges(unit: Column, edges: Column) -> Column:
    """Bounds (0, ..., length) of a unit's pieces by BPE merges."""
    size = F.char_length(unit)
    rank = F.map_from_entries(F.transform(edges, lambda e: F.struct(_key(e["start"] - 1, e["end"]), e["rank"])))

    def step(ranks: Column, bounds: Column) -> Column:
        def joined(k: Column) -> Column:
            edge = F.try_element_at(ranks, _key(F.get(bounds, k - 1), F.get(bounds, k + 1)))
            return F.struct(F.coalesce(edge, F.lit(NONE)).alias("rank"), k.alias("at"))

        best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(bounds) - 2), joined))
        return _let(best, lambda b: F.when(b["rank"] == NONE, bounds).otherwise(F.filter(bounds, lambda x, i: i != b["at"])))

    def fold(ranks: Column) -> Column:
        steps = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.sequence(F.lit(0), size), lambda bounds, _: F.when(F.size(bounds) > 2, step(ranks, bounds)).otherwise(bounds))

    return _let(rank, fold)


def viterbi(unit: Column, edges: Column) -> Column:
    """Bounds of a unit's pieces on the path with the highest sum of scores; a character without a piece costs 1e6."""
    size = F.char_length(unit)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("bounds")))

    def extend(paths: Column, end: Column) -> Column:
        ending = F.filter(edges, lambda e: (e["end"] == end) & e["id"].isNotNull())
        over = lambda e: F.struct((F.get(paths, e["start"] - 1)["score"] + e["score"]).alias("score"), e["start"].alias("start"))
        bare = F.struct((F.get(paths, end - 1)["score"] - 1e6).alias("score"), end.alias("start"))
        best = F.array_max(F.concat(F.transform(ending, over), F.array(bare)))
        add = lambda b: F.struct(b["score"].alias("score"), F.concat(F.get(paths, b["start"] - 1)["bounds"], F.array(end)).alias("bounds"))
        return F.concat(paths, F.array(_let(best, add)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), size), start, extend), -1)["bounds"]


def encode_units(units: DataFrame, pieces: Pieces, fold=merges) -> DataFrame:
    """(unit, ids) of distinct units of at most MAX_UNIT characters, by the lattice."""
    by_span = F.map_from_entries(F.transform("edges", lambda e: F.struct(_key(e["start"] - 1, e["end"]), e["id"])))
    bounded = lattice(units, pieces).select("unit", fold(F.col("unit"), F.col("edges")).alias("bounds"), by_span.alias("by_span"))

    def bytes_of(char: Column) -> Column:
        digits = F.hex(F.encode(char, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + pieces.first_byte)

    def ids_of(k: Column) -> Column:
        begin, end = F.get("bounds", k - 1), F.get("bounds", k)
        known = F.try_element_at("by_span", _key(begin, end))
        return F.when(known.isNotNull(), F.array(known)).otherwise(bytes_of(F.substring(F.col("unit"), begin + 1, end - begin)))

    return bounded.select("unit", F.flatten(F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), ids_of)).alias("ids"))


def frequent_units(docs: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """At most `most` of the commonest units of a blank and a word, of at most MAX_UNIT characters: unit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def kept() -> pd.DataFrame:
            rows = [(BLANK + w, n) for w, n in counts.items() if n >= LEAST_COUNT and 0 < len(w) < MAX_UNIT and BLANK not in w and "\n" not in w]
            return pd.DataFrame(rows, columns=["unit", "n"])

        counts: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    counts.update(text.split(" "))
            if len(counts) > REMEMBERED:
                yield kept()
                counts.clear()
        yield kept()

    found = docs.select("text").mapInPandas(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return found.orderBy(F.col("n").desc(), "unit").limit(most).select("unit")


class Encoder(dict):
    """Encodes and decodes within a task. It maps what stands between two single blanks to its ids: frequent words' ids are
    given, others are folded when first met. Texts with runs of blanks are cut into runs one by one."""

    def __init__(self, pieces: Pieces, frequent: dict[str, tuple[int, ...]]):
        self.frequent = {u[1:]: ids for u, ids in frequent.items()}
        super().__init__(self.frequent)
        self.pieces = pieces
        places = {s: i for i, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
        self.ranks = {p: places[s] for p, _, s in pieces.rows}
        self.ids = {p: i for p, i, _ in pieces.rows}
        self.bytes = np.full(max(max(self.ids.values()), pieces.first_byte + 255) + 1, b"", dtype=object)
        for p, i, _ in pieces.rows:
            self.bytes[i] = p.replace(BLANK, " ").encode("utf-8")
        for b in range(256):
            self.bytes[pieces.first_byte + b] = bytes([b])

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(word) >= MAX_UNIT:
            return tuple(chain.from_iterable(map(self.run, runs_of(word))))
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.frequent)
        self[word] = ids = self.fold(BLANK + word) if "\n" not in word else tuple(chain.from_iterable(map(self.run, runs_of(word))))
        return ids

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a run."""
        if len(run) <= MAX_UNIT:
            return self.fold(run)
        return tuple(i for u in units_of(run, self.pieces) for i in (self.fold(u) if len(u) <= MAX_UNIT else self.fold_long(u)))

    def _ids(self, parts) -> tuple[int, ...]:
        ids = self.ids
        try:
            return tuple([ids[p] for p in parts])
        except KeyError:  # a character without a piece
            return tuple(i for p in parts for i in ([ids[p]] if p in ids else (self.pieces.first_byte + b for b in p.encode("utf-8"))))

    def fold(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit by merges: the adjacent pair with the best rank, leftmost first, until no pair is an edge."""
        parts, rank = list(unit), self.ranks.get
        ranks = list(map(rank, map(add, unit, unit[1:]), repeat(NONE)))
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, NONE)
        return self._ids(parts)

    def fold_long(self, unit: str) -> tuple[int, ...]:
        """The same fold with a heap of pairs, whose cost grows little faster than the unit."""
        parts, ranks = list(unit), self.ranks
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, unit[i : i + 2]) for i in range(len(parts) - 1) if (r := ranks.get(unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, text = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j], after[i] = text, None, after[j]
            if (k := after[i]) < len(parts):
                before[k] = i
                if (r := ranks.get(text + parts[k])) is not None:
                    heappush(heap, (r, i, text + parts[k]))
            if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + text)) is not None:
                heappush(heap, (r, k, parts[k] + text))
        return self._ids([p for p in parts if p is not None])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            ids = map(self.run, runs_of(text))
        else:
            ids = map(self.__getitem__, text.split(" "))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank that encoding puts first."""
        return b"".join(self.bytes.take(ids).tolist()).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids and text (decoded from the ids) of every row of `docs` (doc_id, text), by a BPE model."""
    pieces = Pieces.of_model(model_file)
    rows = encode_units(frequent_units(docs), pieces).collect()  # MAX_FREQUENT rows at most
    known = docs.sparkSession.sparkContext.broadcast((pieces, {r["unit"]: tuple(r["ids"]) for r in rows}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*known.value)

        def done(ids: list, rows: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), lists, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

        for batch in batches:
            ids, rows, texts, held = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row = encoder.encode(text)
                ids.append(doc_id)
                rows.append(row)
                texts.append(encoder.decode(row))
                if (held := held + len(row)) > BATCH_IDS:
                    yield done(ids, rows, texts)
                    ids, rows, texts, held = [], [], [], 0
            if ids:
                yield done(ids, rows, texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")
