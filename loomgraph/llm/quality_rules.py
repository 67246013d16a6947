"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Tokens are runs of letters and digits and runs of other signs, lower-cased. Uni- and bigrams hash to `BUCKETS`
buckets. Two multinomials over the buckets, of the trusted texts and of the whole corpus (each with one added
count), give every document the mean log ratio of its n-grams. A document stays if its mean reaches the threshold: the
same text is always judged alike for the same corpus. The threshold comes from trusted texts that the ratio hasn't learnt from (one
in `HELD_BACK` ids): `SPREADS` times as far below their median as their lowest percentile is, `LEAST_SPREAD` at least.

The raw counts cover every document. The trusted side is fitted on about `MAX_TRUSTED` labelled ids at most
(a hash of the id chooses them), a documented bound; so their set can be sent to each task.

Null and empty texts have zero counts and fail the base rules. Without trusted texts the ratio is 0, without any held back there is
no threshold, and the base rules alone decide. Repeated rows and ties are judged alike. Labels may be absent, repeated or null.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 10_000
MAX_TRUSTED = 200_000
#: One in so many trusted ids is held back for the threshold.
HELD_BACK = 5
SPREADS, LEAST_SPREAD = 3.0, 0.1
#: Base rules: fewest words, and the largest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


class TokenHashes(dict):
    """crc32 of tokens, remembered for the common ones."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8"))
        return value


def ngram_buckets(text: str, hashes: TokenHashes) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    tokens = np.array([hashes[t] for t in TOKEN.findall(text.lower())], dtype=np.uint64)
    pairs = tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([tokens * np.uint64(0xD6E8FEB86659FD93), pairs])
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(BUCKETS)


def repeated_window_words(ids: np.ndarray, window: int = 3) -> int:
    """Words in windows of three that occur twice or more in the text."""
    n = len(ids)
    if n <= window:
        return 0
    key = ids[: n - window + 1]
    for j in range(1, window):
        base = int(ids.max()) + 1
        if int(key.max()) >= 2**62 // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[j : n - window + 1 + j]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(n, dtype=bool)
    for j in range(window):
        covered[j : n - window + 1 + j] |= hit
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8")
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(data.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(ids),
    )


def trusted_ids(labels: DataFrame) -> np.ndarray:
    """Sorted ids of about MAX_TRUSTED documents at most, labelled as of good quality and not toxic; a hash chooses them."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, MAX_TRUSTED / max(good.count(), 1))
    ids = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    return np.sort(ids.toPandas()["doc_id"].to_numpy(dtype=np.int64))


def log_ratio(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """log(trusted / raw) for each bucket, from the counts of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, raw, good = TokenHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                if text:
                    counts = np.bincount(ngram_buckets(text, hashes).astype(np.int64), minlength=BUCKETS)
                    raw += counts
                    if not pd.isna(doc_id) and (at := np.searchsorted(trusted, int(doc_id))) < len(trusted) and trusted[at] == doc_id:
                        good += counts
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "good": good[used]})

    counts = docs.select("doc_id", "text").mapInPandas(count, "bucket long, raw long, good long")
    pdf = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[pdf["bucket"].to_numpy(dtype=np.int64)] += pdf["raw"].to_numpy(dtype=np.int64)
    good[pdf["bucket"].to_numpy(dtype=np.int64)] += pdf["good"].to_numpy(dtype=np.int64)
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def scores(text: Column, ratio: np.ndarray) -> Column:
    """Mean log ratio of each text's n-grams."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = TokenHashes()
        for texts in batches:
            yield pd.Series([_score(t, ratio, hashes) for t in texts], dtype="float64")

    return run(text)


def _score(text: str | None, ratio: np.ndarray, hashes: TokenHashes) -> float:
    buckets = ngram_buckets(text or "", hashes).astype(np.int64)
    return float(ratio[buckets].mean()) if len(buckets) else 0.0


@dataclass(frozen=True)
class Rules:
    """What fitting gives: the log ratio of each bucket, and the lowest mean that stays."""

    ratio: np.ndarray
    threshold: float


def verdicts(text: Column, rules: Rules) -> Column:
    """A struct of the base counts, base_failed, score (mean log ratio) and kept for each text."""

    @F.pandas_udf(VERDICT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()

        def judge(text: str | None) -> tuple:
            counts = base_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]
            score = _score(text, rules.ratio, hashes)
            return (*counts, failed, score, not failed and score >= rules.threshold)

        names = [c.split()[0] for c in VERDICT.split(", ")]
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=names)

    return run(text)


def threshold(docs: DataFrame, held_back: np.ndarray, ratio: np.ndarray) -> float:
    """The lowest mean that stays, from the texts of the ids held back."""
    few = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": held_back}), "doc_id long")  # MAX_TRUSTED / HELD_BACK ids at most
    texts = docs.where("length(text) > 0").join(F.broadcast(few), "doc_id", "left_semi").select("text")
    low, middle = texts.select(scores(F.col("text"), ratio).alias("score")).agg(F.percentile("score", 0.01), F.percentile("score", 0.5)).first()
    return -math.inf if middle is None else middle - SPREADS * max(middle - low, LEAST_SPREAD)


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    trusted = trusted_ids(labels)
    back = np.array([zlib.crc32(str(i).encode()) % HELD_BACK == 0 for i in trusted], dtype=bool)
    ratio = log_ratio(docs, trusted[~back])
    return Rules(ratio, threshold(docs, trusted[back], ratio) if ratio.any() else -math.inf)
