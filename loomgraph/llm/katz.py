"""Katz backoff language model of order `ORDER`: every word is a type of its own, counts live in partitioned tables.

Tokens are the words of a text, lower-cased (A-Z), and one end token; a text starts after `ORDER - 1` begin marks. The
probability of a token w after a history h is found recursively:

1. D(c(h w)) / c(h), if training has seen h w: D takes the Good-Turing discount off the count,
2. else alpha(h) times the probability of w after the history without its first word (alpha is 1 if h wasn't seen),
3. at the end D(c(w)) / N for a seen word, and for any unseen one what the discounts have freed there.

Discounts are Katz's for counts up to `K`, from counts of counts; a larger count loses as much as K does, so every history
keeps something for what it hasn't seen. Where Good-Turing can't give discounts between 0 and 1 (small or odd corpora),
absolute discounting by 1/2 takes its place. alpha(h) = (1 - sum of D(c(h w)) / c(h)) / (1 - sum of P(w | h without its
first word)), both sums over the words seen after h, so the probabilities after each history sum to 1.

Documents are tokenised once, into blocks of about `BLOCK_TOKENS` tokens (a longer document is one block). A round of the
work asks: each block sends its distinct n-grams, sorted, with its own counts, to hash buckets; a bucket adds
up what all blocks have sent and answers each block in the order of its question. A hot word or n-gram is so one number for each
block, and no bucket holds more than its share. Round 1 counts words and pairs. Each later round counts n-grams one word
longer, and adds up the two sums of alpha for histories two words shorter than those. Answers are stored by block, in
tables bucketed like the blocks, so tokens are never shuffled.

Three things are known without asking, and are not sent: a training n-gram whose history occurs once in training, and in no
held-out text, occurs once; a held-out n-gram whose history or whose last words training hasn't seen has count 0; alpha is
needed for histories that held-out texts hold.

Null texts are empty (one end token). Repeated rows and repeated doc_ids are scored and counted separately, null doc_ids
stay null. With no training rows every token is unseen and has probability 1 as the only known outcome. Other columns of the
input aren't read. Words are told apart by 64-bit hashes, n-grams by 64-bit hashes of their words' hashes. Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_table

ORDER = 3
K = 5
BLOCK_TOKENS = 2**20
#: Keys of all blocks in one bucket, about.
BUCKET_KEYS = 2**19
END = b""
#: Histories of begin marks alone, by length.
BEGIN = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(16)]


@dataclass(frozen=True)
class Discounts:
    """Factors for counts 0 to K (index) and what is taken off larger counts."""

    low: np.ndarray
    off: float

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        counts = np.asarray(counts, dtype=np.float64)
        return np.where(counts <= K, counts * self.low[np.minimum(counts, K).astype(np.int64)], counts - self.off)


def good_turing(of_counts: np.ndarray) -> Discounts:
    """Katz discounts from of_counts[r], the number of types seen r times, r from 1 to K + 1."""
    n = np.asarray(of_counts, dtype=np.float64)
    low = np.array([0.0, *(1 - 0.5 / r for r in range(1, K + 1))])
    if n[1:].all() and (common := (K + 1) * n[K + 1] / n[1]) < 1:
        r = np.arange(1, K + 1)
        d = ((r + 1) * n[2:] / (r * n[1:-1]) - common) / (1 - common)
        if ((d > 0) & (d < 1)).all():
            low = np.array([0.0, *d])
    return Discounts(low, K * (1 - low[K]))


@dataclass(frozen=True)
class Model:
    """What every task must know: sizes of the training part, discounts by order, numbers of buckets. Its size is fixed."""

    order: int
    tokens: int = 0
    texts: int = 0
    types: int = 0
    buckets: dict[str, int] = field(default_factory=dict)
    discounts: dict[int, Discounts] = field(default_factory=dict)
    unseen: float = 1.0  # probability of all words that training hasn't seen


@cache
def _zstandard():
    """A compressor and a decompressor for all of a task: making them costs more than most of what they are given."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _compress(data: bytes) -> bytes:
    return _zstandard()[0].compress(data)


def _decompress(data: bytes) -> bytes:
    return _zstandard()[1].decompress(data)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array's numbers, all first bytes before all second ones: small numbers then compress to little."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _of_planes(data: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.copy().view(dtype).reshape(n)


def packed(*columns: np.ndarray) -> bytes:
    """Numbers of 8 bytes each, column after column."""
    return _compress(b"".join(map(_planes, columns)))


def unpacked(data: bytes, *dtypes) -> list[np.ndarray]:
    raw = _decompress(data)
    n = len(raw) // (8 * len(dtypes))
    return [_of_planes(raw[i * 8 * n : (i + 1) * 8 * n], d, n) for i, d in enumerate(dtypes)]


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64)[0], dtype=np.uint64)


def longer(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of histories with a word added."""
    x = history * np.uint64(0x9FB21C651E98DF25) + words * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def tokenised(docs: DataFrame, held_out: Column, scratch: Scratch) -> DataFrame:
    """Blocks of documents: doc_ids, held, tokens in each, the distinct words' hashes, and all tokens as places in them."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        places: dict[bytes, int] = {}
        ids, nameless, held, lengths, tokens, size = [], [], [], [], [], 0

        def block() -> pd.DataFrame:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in places], dtype=np.uint64)
            data = _compress(_planes(np.concatenate(tokens)))
            return pd.DataFrame({"block": [part << 32 | made], "doc_ids": [ids], "nameless": [nameless], "held": [held], "lengths": [lengths], "words": [hashes.tobytes()], "tokens": [data]})

        for pdf in batches:
            for doc_id, text, out in zip(pdf.doc_id, pdf.text, pdf.held):
                words = text.encode("utf-8").lower().split() if text else []
                words.append(END)
                if size and size + len(words) > BLOCK_TOKENS:
                    yield block()
                    made += 1
                    places, ids, nameless, held, lengths, tokens, size = {}, [], [], [], [], [], 0
                ids.append(int(doc_id or 0))
                nameless.append(doc_id is None)
                held.append(bool(out))
                lengths.append(len(words))
                size += len(words)
                tokens.append(np.array([places.setdefault(w, len(places)) for w in words], dtype=np.int32))
        if lengths:
            yield block()

    schema = "block long, doc_ids array<long>, nameless array<boolean>, held array<boolean>, lengths array<int>, words binary, tokens binary"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out.alias("held"))
    return scratch.bucketed(rows.mapInPandas(blocks, schema), "blocks", "block")


class Block:
    """A block's tokens, and their counts as far as rounds have answered."""

    def __init__(self, row, model: Model):
        self.model, self.lengths = model, np.asarray(row.lengths)
        self.held_texts = np.asarray(row.held, dtype=bool)
        self.held = np.repeat(self.held_texts, self.lengths)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.size = int(self.ends[-1])
        words = np.frombuffer(row.words, np.uint64)
        self.grams = {1: words[_of_planes(_decompress(row.tokens), np.int32, self.size)]}
        self.answers: dict[str, dict[int, bytes]] = {}
        for name in row.index:
            for x in row[name] if name.startswith("answers") and row[name] is not None else ():
                self.answers.setdefault(x["kind"], {})[x["bucket"]] = x["data"]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """Each token's value of the token before it."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = at_start
        return out

    def history(self, k: int) -> np.ndarray:
        """Hashes of the k - 1 words before each token."""
        return self.before(self.gram(k - 1), BEGIN[k - 1])

    def gram(self, k: int) -> np.ndarray:
        if k not in self.grams:
            self.grams[k] = longer(self.history(k), self.grams[1])
        return self.grams[k]

    def asked(self, k: int) -> np.ndarray:
        """Which tokens' k-grams must be asked for."""
        if k <= 2:
            return np.ones(self.size, dtype=bool)
        times, wanted = self.history_counts(k)
        return np.where(self.held, (times > 0) & (self.counts(k - 1)[0] > 0), (times > 1) | wanted)

    def history_counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """How often training has the history of each token's k-gram, and whether a held-out text has it."""
        times, wanted = self.counts(k - 1)
        return self.before(times, self.model.texts), self.before(wanted, True)

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The training count of each token's k-gram, and whether a held-out text has it."""
        if k not in self.known:
            mask = self.asked(k)
            keys, inverse = np.unique(self.gram(k)[mask], return_inverse=True)
            times, wanted = self.restored(f"gram{k}", keys, np.int64, np.int64)
            all_times, all_wanted = (~self.held).astype(np.int64), np.zeros(self.size, dtype=bool)
            all_times[mask], all_wanted[mask] = times[inverse], wanted[inverse] > 0
            self.known[k] = all_times, all_wanted
        return self.known[k]

    def dealt(self, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' buckets, and their places in order of buckets."""
        buckets = self.model.buckets[kind]
        bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 2**16 else np.uint32)
        return bucket, np.argsort(bucket, kind="stable")

    def restored(self, kind: str, keys: np.ndarray, *dtypes) -> list[np.ndarray]:
        """Answers in the order of the sorted keys."""
        order = self.dealt(kind, keys)[1]
        parts = [unpacked(data, *dtypes) for _, data in sorted(self.answers.get(kind, {}).items())]
        out = []
        for i, dtype in enumerate(dtypes):
            column = np.empty(len(keys), dtype)
            column[order] = np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype)
            out.append(column)
        return out

    def questions(self, kind: str, keys: np.ndarray, values: list[np.ndarray], wanted: bool) -> list[tuple]:
        """Sorted distinct keys with their values, cut into buckets."""
        bucket, by = self.dealt(kind, keys)
        used, starts = np.unique(bucket[by], return_index=True)
        return [(kind, int(b), packed_keys(keys[i]), packed(*[v[i] for v in values]) if values else b"", wanted) for b, i in zip(used, np.split(by, starts[1:]))]

    def gram_questions(self, k: int) -> list[tuple]:
        mask = self.asked(k)
        keys, inverse = np.unique(self.gram(k)[mask], return_inverse=True)
        held = self.held[mask]
        n = [np.bincount(inverse[side], minlength=len(keys)).astype(np.int64) for side in (~held, held)]
        return self.questions(f"gram{k}", keys, n, True)

    def lower(self, k: int) -> np.ndarray:
        """Probability of each token by its k-gram, which training has seen."""
        times = self.counts(k)[0]
        return self.model.discounts[k](times) / (self.model.tokens if k == 1 else np.maximum(self.history_counts(k)[0], 1))

    def without(self, k: int) -> np.ndarray:
        """Held-out tokens whose k-gram training hasn't seen, though it has their history."""
        return self.held & (self.counts(k)[0] == 0) & (self.history_counts(k)[0] > 0)

    def weight_questions(self, k: int) -> list[tuple]:
        """Parts of the sums for alpha of histories of k words, and histories whose alpha is wanted."""
        times, history = self.counts(k + 1)[0], self.history(k + 1)
        give = ~self.held & self.history_counts(k + 1)[1]
        keys, inverse = np.unique(history[give], return_inverse=True)
        # A type seen c times is met c times, so each time gives a c-th part.
        share = times[give]
        kept = np.bincount(inverse, self.model.discounts[k + 1](share) / share, len(keys))
        below = np.bincount(inverse, self.lower(k)[give] / share, len(keys))
        return [*self.questions(f"alpha{k}", keys, [kept, below], False), *self.questions(f"alpha{k}", np.unique(history[self.without(k + 1)]), [], True)]

    def alpha(self, k: int) -> np.ndarray:
        """log10 of the backoff weight of the histories of k words at the tokens that need it, else 0."""
        need = self.without(k + 1)
        keys, inverse = np.unique(self.history(k + 1)[need], return_inverse=True)
        kept, below = (x[inverse] for x in self.restored(f"alpha{k}", keys, np.float64, np.float64))
        out = np.zeros(self.size)
        out[need] = np.log10((1 - kept / self.history_counts(k + 1)[0][need]) / np.maximum(1 - below, 1e-15))
        return out

    def scores(self) -> np.ndarray:
        """log10 probability of each token."""
        out, unsolved = np.zeros(self.size), np.ones(self.size, dtype=bool)
        for k in range(self.model.order, 1, -1):
            seen = unsolved & (self.counts(k)[0] > 0)
            out[seen] += np.log10(self.lower(k)[seen])
            unsolved &= ~seen
            out[unsolved] += self.alpha(k - 1)[unsolved]
        seen = unsolved & (self.counts(1)[0] > 0)
        out[seen] += np.log10(self.lower(1)[seen])
        out[unsolved & ~seen] += np.log10(self.model.unseen)
        return out


ASKED = "kind string, bucket int, keys binary, values binary, wanted boolean, block long"
ANSWERED = "kind string, bucket int, data binary, block long, of_counts array<long>"


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers to its questions, and for n-grams a row of counts of counts (0 to K + 1), tokens and types."""
    kind, bucket = key
    grams = kind.startswith("gram")
    pdf = pdf.sort_values(["block", "wanted"])  # sums of floats in one order
    asked = [unpacked_keys(k) for k in pdf["keys"]]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    number = np.int64 if grams else np.float64
    values = [unpacked(v, number, number) if v else [np.zeros(len(k), number)] * 2 for k, v in zip(asked, pdf["values"])]
    sums = [np.bincount(inverse, np.concatenate([v[i] for v in values]), len(keys)).astype(number) for i in range(2)]
    rows, at = [], 0
    if grams:
        times, sums[1] = sums[0], (sums[1] > 0).astype(np.int64)
        rows.append((None, -1, [*np.bincount(times[times <= K + 1], minlength=K + 2), times.sum(), (times > 0).sum()]))
    for block, wanted, k in zip(pdf["block"], pdf["wanted"], asked):
        if wanted:
            mine = inverse[at : at + len(k)]
            rows.append((packed(sums[0][mine], sums[1][mine]), block, None))
        at += len(k)
    return pd.DataFrame(rows, columns=["data", "block", "of_counts"]).assign(kind=kind, bucket=bucket)[["kind", "bucket", "data", "block", "of_counts"]]


def _round(state: DataFrame, model: Model, kinds: list[tuple[str, int]], name: str, scratch: Scratch) -> tuple[DataFrame, dict[str, list[int]]]:
    """Asks for each of the kinds, ("gram" or "alpha", length): the blocks' answers, and each kind's counts of counts."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                block = Block(row, model)
                for what, k in kinds:
                    rows = block.gram_questions(k) if what == "gram" else block.weight_questions(k)
                    yield pd.DataFrame(rows, columns=["kind", "bucket", "keys", "values", "wanted"]).assign(block=row.block)

    merged = state.mapInPandas(ask, ASKED).groupBy("kind", "bucket").applyInPandas(_merged, ANSWERED)
    merged = scratch.table(merged, f"{name}-buckets", "kind")
    answers = merged.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias(f"answers_{name}"))
    table = scratch.bucketed(answers, name, "block")
    sums = merged.where("block < 0").groupBy("kind").agg(F.array(*[F.sum(F.col("of_counts")[i]) for i in range(K + 4)]).alias("sums")).collect()
    return table, {r["kind"]: list(r["sums"]) for r in sums}


def _learned(model: Model, k: int, sums: list[int]) -> Model:
    """The model with the discounts of order k. What wasn't asked for are training types of one token each."""
    of_counts, tokens, types = np.array(sums[: K + 2]), sums[-2], sums[-1]
    if k > 1:
        of_counts[1] += model.tokens - tokens
    discounts = good_turing(of_counts)
    model = replace(model, discounts=model.discounts | {k: discounts})
    if k > 1 or not tokens:
        return model
    r = np.arange(1, K + 1)
    freed = (of_counts[1 : K + 1] * (r - discounts(r))).sum() + discounts.off * (types - of_counts[1 : K + 1].sum())
    return replace(model, tokens=tokens, types=types, unseen=float(freed / tokens))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(state: DataFrame, model: Model) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                block = Block(row, model)
                times = block.counts(1)[0]
                base = np.log10((times + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                total = lambda x: np.add.reduceat(x, block.starts)
                ids = pd.arrays.IntegerArray(np.array(row.doc_ids, dtype=np.int64), np.array(row.nameless, dtype=bool))
                yield pd.DataFrame(
                    {
                        "doc_id": ids, "held_out": block.held_texts, "n_tokens": block.lengths, "n_known": total((times > 0).astype(np.int64)),
                        "train_tokens": model.tokens, "base_score": total(base), "score": total(block.scores()),
                    }
                )

    return state.mapInPandas(score, SCORED)


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows of `docs` (doc_id, text): its tokens, how many are
    known, the unigram base score and the model's score."""
    scratch = Scratch(docs.sparkSession, "katz")
    blocks = tokenised(docs, held_out, scratch)
    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    taught = F.size(F.filter("held", lambda x: ~x))
    sizes = blocks.agg(F.sum(F.octet_length("words")), F.sum(tokens), F.sum(taught)).first()
    n_words, n_tokens, texts = (int(x or 0) for x in sizes)
    few, many = (max(1, -(-n // BUCKET_KEYS)) for n in (n_words // 8, n_tokens))
    kinds = {f"{what}{k}": few if k == 1 else many for what in ("gram", "alpha") for k in range(1, order + 1)}
    model, state = Model(order, texts=texts, buckets=kinds), blocks
    asked = [("gram", k) for k in range(1, min(order, 2) + 1)]
    for k in range(2, order + 2):
        table, sums = _round(state, model, asked, f"round{k - 1}", scratch)
        state = state.join(table, "block", "left")
        for what, n in asked:
            if what == "gram":
                model = _learned(model, n, sums.get(f"gram{n}", [0] * (K + 4)))
        asked = [("gram", k + 1)] * (k < order) + [("alpha", k - 1)]
    result = shared_table(_scored(state, model), "katz-scores")
    scratch.clear()
    return result
