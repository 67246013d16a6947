"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's features are its character n-grams (1 to 3, letters only, words apart) hashed to `BUCKETS` rows of an embedding
table. Their mean goes through a linear softmax. Table and softmax are trained together by stochastic gradient
descent in numpy on at most `MAX_SAMPLE` labelled rows (those with the smallest hashes of the id), a documented bound;
each row arrives at the driver as one histogram of BUCKETS counts at most, whatever its length. A tenth of the
sample is held back: it sets the softmax's temperature and the confidence under which a text is rejected.

Null texts and texts without a letter are `und` with score 0, and rejected. Labels that are null don't teach. Without any
labelled text every text is `und`. Repeated rows and ties are predicted alike (ties: the first language by name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, WIDTH = 4_096, 24
MAX_SAMPLE = 6_000
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Least number of steps; small samples are gone through more often.
LEAST_STEPS = 1_500
#: Share of rightly predicted held-back texts that rejection may cost, and the confidence it stays below.
REJECTED_SHARE, REJECT_BELOW = 0.002, 0.6
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """True at the code points that are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def histogram(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's subwords; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.where(letter, points, np.uint32(32))
    inside = letter[1:] | letter[:-1]
    points = np.concatenate([points[:1], points[1:][inside]])  # one blank between words
    c = np.concatenate([[32], points, [32]]).astype(np.uint64)
    grams = [c[c != 32] * np.uint64(0x9E3779B1)]
    two = c[:-1] * np.uint64(0x85EBCA77) + c[1:] * np.uint64(0xC2B2AE3D) + np.uint64(1)
    grams.append(two)
    if len(c) > 2:
        grams.append((two[:-1] * np.uint64(0x27D4EB2F) + c[2:] * np.uint64(0x165667B1)) + np.uint64(2))
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    counts = np.bincount((mixed % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # a bucket's embedding times the softmax weights: its logits
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        used, counts = histogram(text)
        if not len(used) or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax((counts @ self.table[used] / counts.sum() + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 1) -> Model:
    """Fits a model to histograms and their languages, in the order given."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 10 == 9
    fit_on = np.flatnonzero(~held)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    dense = lambda rows: np.stack([_dense(*features[i]) for i in rows])
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(fit_on), 1)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(fit_on)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = dense(rows)
            mean = x @ table
            error = softmax(mean @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= rate * 10 * mean.T @ error
            bias -= rate * error.sum(axis=0)
            table -= rate * 10 * x.T @ back
    logits = table @ weights
    check = np.flatnonzero(held) if held.any() else fit_on
    z = np.stack([c @ logits[u] / c.sum() + bias for u, c in (features[i] for i in check)])
    loss = {t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    temperature = float(min(loss, key=loss.get))
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    reject = min(REJECT_BELOW, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    return Model(languages, logits, bias, temperature, reject)


def _dense(used: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = np.zeros(BUCKETS, np.float32)
    x[used] = counts / counts.sum()
    return x


def fit(docs: DataFrame, learn_from: Column, max_sample: int = MAX_SAMPLE) -> Model:
    """Trains on the rows of `docs` (doc_id, text, lang) that `learn_from` allows."""
    order = F.xxhash64("doc_id")
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(order.alias("h"), "doc_id", "text", "lang")
    last = rows.select("h").orderBy("h").limit(max_sample).agg(F.max("h")).first()[0]
    if last is None:
        return train([], [])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [histogram(t) for t in pdf.text]
            packed = {"used": [u.astype(np.int16).tobytes() for u, _ in bags], "counts": [c.astype(np.int32).tobytes() for _, c in bags]}
            yield pd.DataFrame({"h": pdf.h, "doc_id": pdf.doc_id, "lang": pdf.lang} | packed)

    sample = rows.where(F.col("h") <= last).mapInPandas(features, "h long, doc_id long, lang string, used binary, counts binary")
    got = sample.where(F.length("used") > 0).orderBy("h", "doc_id", "lang", "used").limit(max_sample).collect()
    return train([(np.frombuffer(r.used, np.int16).astype(np.int64), np.frombuffer(r.counts, np.int32).astype(np.int64)) for r in got], [r.lang for r in got])


def predictions(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and rejected for each text."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return run(text)
