"""Katz backoff, mixing, top-k search, SimHash classes, WARC archives and the pipeline against brute force."""

from __future__ import annotations

import glob
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import katz, mixing, shingle_join, simhash, topk, warc
from loomgraph.llm import queries as llm
from loomgraph.llm.common import crc_fold

from .test_text_operators import DOC, ODD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


# Katz backoff


def brute_base(rows):
    tokens = {d: (t or "").encode().lower().split() + [b""] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def test_katz_base_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_base(texts.items())
    got = llm.op2_katz_backoff(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    tokens = sum(r.n_tokens for r in got if r.held_out)
    assert sum(r.score for r in got if r.held_out) / tokens > sum(r.base_score for r in got if r.held_out) / tokens


class BruteKatz:
    """A second, direct reading of the model over whole words: P(word | history) by recursion, nothing merged or left out."""

    def __init__(self, train, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for ws in train:
            padded = ["<s>"] * (order - 1) + ws
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
        of = lambda c: np.array([0] + [sum(v == r for v in c.values()) for r in range(1, 7)])
        self.d = [None] + [katz.good_turing(of(c)) for c in self.counts[1:]]
        self.after = defaultdict(dict)
        for c in self.counts[1:]:
            for g, v in c.items():
                self.after[g[:-1]][g[-1]] = v
        self.n = sum(self.counts[1].values())
        self.unseen = 1 - sum(float(self.d[1](v)) for v in self.counts[1].values()) / self.n

    def p(self, history, w):
        if not history:
            c = self.counts[1][(w,)]
            return float(self.d[1](c)) / self.n if c else self.unseen
        seen = self.after.get(history)
        if not seen:
            return self.p(history[1:], w)
        n, d = sum(seen.values()), self.d[len(history) + 1]
        if w in seen:
            return float(d(seen[w])) / n
        alpha = (1 - sum(float(d(v)) for v in seen.values()) / n) / (1 - sum(self.p(history[1:], x) for x in seen))
        return alpha * self.p(history[1:], w)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_scores_and_normalisation(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_KEYS", 200)
    rng = random.Random(2)
    words = [f"w{min(int(rng.expovariate(0.12)), 90)}" for _ in range(4000)]
    texts = [(i, " ".join(words[i * 13 : i * 13 + rng.randrange(1, 13)])) for i in range(300)] + [(900, None), (901, "Unseen UNSEEN w1"), (2**60 + 1, "w1 w2"), (2**60 + 1, "w1 w2"), (None, "w3"), (905, "w2 " * 700)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"block": F.lit(1), "held": F.lit(True), "words": F.lit("x")}).repartition(5)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    model = BruteKatz([tokens(t) for d, t in texts if not held(d)], order)
    vocabulary = [w for (w,) in model.counts[1]] + [b"never"]
    for h in rng.sample(sorted(model.after, key=repr), 40) if order > 1 else [()]:
        assert sum(model.p(h, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    want = defaultdict(list)
    for d, t in texts:
        padded = ["<s>"] * (order - 1) + tokens(t)
        want[d].append(sum(math.log10(model.p(tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded))))
    got = defaultdict(list)
    for r in katz.score_documents(df, crc_fold("doc_id", 5) == 1, order).collect():
        got[r.doc_id].append(r.score)
    assert set(got) == set(want)
    for d in want:
        assert sorted(got[d]) == pytest.approx(sorted(want[d]), rel=1e-9)


def test_katz_odd_rows(spark, odd):
    got = katz.score_documents(odd, crc_fold("doc_id", 5) == 1).collect()
    assert len(got) == len(ODD) and all(r.n_tokens >= 1 and r.score <= 0 for r in got)
    assert katz.score_documents(odd.limit(0), F.lit(False)).count() == 0
    none = katz.score_documents(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in none)
    long = spark.createDataFrame([(1, "ab cd " * 400_000), (2, "x"), (3, "y" * 3_000_000)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in katz.score_documents(long, F.col("doc_id") == 2).collect()) == [2, 2, 800_001]


def test_good_turing():
    d = katz.good_turing(np.array([0, 100, 40, 20, 12, 8, 6]))
    assert d.off == pytest.approx(5 * (1 - d.low[5])) and ((d.low[1:] > 0) & (d.low[1:] < 1)).all()
    assert katz.good_turing(np.array([0, 5, 0, 0, 0, 0, 0])).off == pytest.approx(0.5)


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(3 * sizes[s])
            left -= 3 * sizes[s]
        open_ -= over
    return target


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    target = brute_targets(sizes)
    source = {r.doc_id: r.source for r in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_mix_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = llm.op3_source_mixing(spark, SF).collect()
    check_mix(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, llm.op3_source_mixing(spark, SF).collect()))


def test_mix_with_many_ranges_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice([None, "a", "b", "z", "z", "z", "ü", "B"]), 0) for i in range(600)] + [(1000, "w " * 3, "en", "tiny", 0)]
    df = spark.createDataFrame(rows, DOC).repartition(6)
    check_mix(mixing.mix_documents(df).collect(), df.collect())
    kept = mixing.mixed_documents(df)
    times = Counter(r.doc_id for r in kept.collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(df).collect() if r.taken}
    assert times == want and kept.columns == df.columns


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_documents(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd.withColumns({"mix_size": F.lit(1), "of_id": F.lit(1), "taken": F.lit(1)})).columns == [*odd.columns, "mix_size", "of_id", "taken"]


# Top-k


def brute_top(rows, k=5):
    """Results as a sorted list; rows that share an id are rows of their own."""
    vecs = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vecs.append((i, tuple(math.floor(256 * x) for x in map(float, np.array(v, np.float32)))))
    out = []
    for n, (q, v) in enumerate(vecs):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(vecs) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("unit", [True, False])
def test_top_k(spark, monkeypatch, unit):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 12)) * (1 if unit else rng.exponential(2, size=(700, 1)))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if unit else v
    v[100:140] = v[50]
    rows = [(i, [float(x) for x in np.float32(r)], 0) for i, r in enumerate(v)]
    rows += [(800, None, 0), (850, [1.0, None], 0), (900, [math.nan] * 12, 0), (950, [math.inf] * 12, 0), (1000, [0.0] * 12, 0), (1050, [1.0, 2.0], 0), (1051, [1.0, 1.0], 0), (1100, [], 0), (50, [float(x) for x in np.float32(v[50])], 1), (None, [1.0, 2.0], 0)]
    rows += [(1200, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (1200, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    clash = df.withColumns({"row": F.lit(0), "block": F.lit(1), "dim": F.lit(2), "vec": F.lit(3), "norm2": F.lit(4)})
    assert sorted(tuple(r) for r in topk.top_k(clash, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows)


def test_top_k_ships_only_blocks_that_are_long_enough(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    shipped, meetings = [], topk.meetings
    monkeypatch.setattr(topk, "meetings", lambda *a: shipped.append(meetings(*a).count()) or meetings(*a))
    # The first 20 rows are a hundred times as long as all others and point where the queries do.
    rows = [(i, [float((100 if i < 20 else 1) * (1 + i % 7)), 1.0, 0.5]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows)
    assert shipped[0] <= 6 < 2 * 20  # of 2 query blocks by 20 blocks


def test_top_k_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in llm.op6_exact_top_k(spark, SF).collect()) == brute_top(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.lit(True)).count() == 0


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint) pairs; the smallest doc_id of each row's class."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return {(d, f"{p:016x}", least.get(find(p))) for d, p in prints}


def test_simhash_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in llm.op9_simhash_neardup(spark, SF).collect()} == brute_components([(r.doc_id, brute_print(r.text)) for r in rows])


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {tuple(r) for r in got} == brute_components([(d, brute_print(t)) for d, t, *_ in ODD])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_lose_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:25]:
        for _ in range(8):
            q = p
            for _ in range(rng.randrange(1, 4)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = [tuple(r) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in ((x % (1 << 64), y % (1 << 64)) for x, y in edges))
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    classes = defaultdict(set)
    for p in prints:
        classes[roots.get(signed(p), signed(p))].add(p)
    want = defaultdict(set)
    for d, _, c in brute_components(list(zip(range(len(prints)), sorted(prints)))):
        want[c].add(sorted(prints)[d])
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in want.values()}


# WARC


def brute_warc(rows):
    """Of the rows with the largest page_id of a payload one, whose url is the smallest, is the response."""
    of = defaultdict(list)
    for i, url, h in rows:
        of[h or ""].append((i, url))
    out = Counter()
    for h, pages in of.items():
        owner = max((i for i, _ in pages if i is not None), default=None)
        head = None if owner is None else min(((i, u) for i, u in pages if i == owner), key=lambda x: (x[1] is None, x[1] or ""))
        told = (len(h.encode()), warc.digest(h.encode()))
        for page in pages:
            response = owner is None or page == head
            head = None if page == head else head
            out[page[0], *told, *(("response", None) if response else ("revisit", owner))] += 1
    return out


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x.org/{i}", f"<p>{'text ' * (i % 50)}{i % 60}</p>") for i in range(300)] + [(500, None, None), (501, "a\r\nb", ""), (502, "ü", "ünï\r\n\r\nx"), (503, "big", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), archives=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_warc(rows)
    assert {r.page_id: bytes(r.payload) for r in got if r.payload is not None}.items() <= {i: (h or "").encode() for i, _, h in rows}.items()
    assert df.select(warc.payload_digest(F.col("html")).alias("d"), "html").where("html is null").first().d == warc.digest(b"")


def test_warc_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    assert Counter(map(tuple, llm.op10_warc_archives(spark, SF).collect())) == brute_warc(rows)


def test_warc_rolls_archives(spark, tmp_path):
    rows = [(i if i else None, f"u{i}", "".join(chr(c) for c in range(i, i + 300))) for i in range(100)] + [(2**60 + 1, "u", "x"), (7, "again", "y"), (7, "again", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_digest": F.lit(1), "owner": F.lit(2), "frame": F.lit(3)})
    warc.write_archives(df, str(tmp_path / "r"), archives=2, records=9)
    files = [p for p in glob.glob(str(tmp_path / "r" / "part-*"))]
    assert len(files) >= 12 and all(len(list(warc.read_archive(open(p, "rb").read()))) <= 9 for p in files)
    got = warc.read_archives(spark, str(tmp_path / "r")).collect()
    assert len(got) == len(rows) and {r.page_id for r in got} == {r[0] for r in rows}
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {r[2] for r in rows}


def test_warc_of_a_page_id_that_repeats(spark, tmp_path):
    rows = [(7, "a", "x"), (7, "b", "x"), (7, "b", "x"), (7, None, "x"), (3, "c", "x"), (None, "d", "x"), (8, None, "y"), (8, None, "y"), (None, "e", "z"), (None, "f", "z")] + [(9, "again", "hot")] * 500
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), str(tmp_path / "t"))
    got = warc.read_archives(spark, str(tmp_path / "t")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute_warc(rows)
    assert [r.url for r in got if r.record_type == "response" and r.page_id == 7] == ["a"]


def test_warc_archives_end_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    rng = random.Random(6)
    rows = [(i, "u", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(100_000 if i == 5 else 3_000))) for i in range(90)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "b"), archives=2)
    archives = [open(p, "rb").read() for p in glob.glob(str(tmp_path / "b" / "part-*"))]
    held = [len(list(warc.read_archive(a))) for a in archives]
    assert sum(held) == 90 and len(held) > 4 and all(len(a) <= 60_008 or n == 1 for a, n in zip(archives, held, strict=True))


def test_warc_empty_and_small(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    same = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string")
    warc.write_archives(same, str(tmp_path / "s"), min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, str(tmp_path / "s")).collect()} == {"response"}


def test_warc_errors(spark, tmp_path):
    good = warc.record_bytes(1, "u", b"abc", warc.digest(b"abc"), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"Content-Length", b"Content-Lengthy")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    df = spark.createDataFrame([(1, "a", "x" * 500)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), archives=1)
    content = next(data for p in glob.glob(str(tmp_path / "w" / "part-*")) if (data := open(p, "rb").read()))
    assert len(list(warc.read_archive(content))) == 1
    for bad in (content[4:], content[:-30], content[:40]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


# The pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    was = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in kept.collect())
        kept = stage(spark, kept, SF).persist()
        after = Counter(r.doc_id for r in kept.collect())
        assert kept.columns == docs.columns, name
        assert set(after) <= set(before) and all(r == was[r.doc_id] for r in kept.collect())
        assert max(after.values()) <= (3 if "mixing" in name else 1)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and len(was[d].text.split()) >= 50]
    assert len([d for d in clean if d in first]) >= 0.95 * len(clean) and not [d for d, r in labels.items() if r.quality == 0 and d in first]
    result = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in result.collect()) == Counter(r.doc_id for r in kept.collect())
    assert all(r.text == was[r.doc_id].text for r in result.collect())


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, odd, clash):
    docs = odd.withColumns({"verdict": F.lit(1), "guess": F.lit("x"), "kept": F.lit(True), "size": F.lit(3)}) if clash else odd
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def brute_similar_classes(rows):
    """rows: (doc_id, text); the smallest doc_id of each class of texts whose 5-word shingles have a similarity of 0.8."""
    sets = []
    for d, text in rows:
        words = (text or "").lower().split()
        sets.append((d, {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {find(d) for d in root}


def brute_roots(edges):
    """(node, root) of all nodes with an edge but the roots themselves, as simhash.components lists them."""
    root = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted((n, r) for n, r in root.items() if n != r)


@pytest.mark.parametrize("edges_a_task", [40, 200_000])
def test_components_and_joined_roots_equal_brute_force(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(simhash, "EDGES_A_TASK", edges_a_task)
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)] + [(-(2**63), 2**63 - 1), (7, 7), (1000, 1001)]
    parts = [[*(tuple(rng.sample(range(300), 2)) for _ in range(n)), *more] for n, more in ((60, chain), (80, []), (1, []), (0, []))]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    roots, met = simhash.components(frame(parts[0])), parts[0]
    assert sorted(tuple(r) for r in roots.collect()) == brute_roots(met)
    for part in parts[1:]:
        roots, met = shingle_join.joined_roots(roots, frame(part)), met + part
        assert sorted(tuple(r) for r in roots.collect()) == brute_roots(met)


def test_keep_first_of_odd_rows(spark, odd):
    kept = shingle_join.keep_first(odd.withColumns({"of_id": F.lit(1), "of_key": F.lit(2), "root": F.lit(3)})).collect()
    assert sorted((r.doc_id for r in kept), key=lambda d: (d is None, d)) == [1, 4, 5, 6, 7, 8, 9, None]
    # Texts that share an id are judged each by its class.
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "o p q r s t u"), (0, "o p q r s t u"), (None, "o p q r s t u"), (None, "v w"), (None, "v w")]
    got = shingle_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {tuple(r) for r in got} == {(1, "a b c d e f g"), (1, "h i j k l m n"), (0, "o p q r s t u"), (None, "v w")} and len(got) == 4
    assert shingle_join.keep_first(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
def test_pipeline_links_near_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(shingle_join, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(shingle_join, "PIVOTS", 1 if bucket == 2 else 4)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = [word() for _ in range(20)]
    texts = ["", None, "One two", "one  TWO", "one two three"]
    for _ in range(25):
        base = line + [word() for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = brute_similar_classes(rows)
    assert 20 < len(want) < len(rows) - 20
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shingle_counts_are_of_all_texts(spark):
    """Texts enough for a sample of every other one, as the order once was counted from."""
    texts, keys_of = 12_000, lambda text: shingle_join._count_key(shingle_join.shingles(text), bits).tolist()
    same = spark.range(texts).selectExpr("id AS doc_id", "concat('one line for all of them ', id) AS text")
    found = shingle_join.common_shingles(same)
    assert found[-1].tolist() == [texts] * 2
    bits, keys, counts = found
    assert dict(zip(keys.tolist(), counts.tolist())) == dict.fromkeys(keys_of("one line for all of them"), texts) and keys.tolist() == sorted(keys)
    docs = spark.range(texts).selectExpr("id AS doc_id", "concat('one line for all x', id, IF(id % 1500 = 7, ' a b c d e f', '')) AS text").repartition(5)
    bits, keys, counts = shingle_join.common_shingles(docs)
    assert dict(zip(keys.tolist(), counts.tolist())) == dict.fromkeys(keys_of("a b c d e f"), texts // 1500) and len(keys) == 2
    assert [len(x) for x in shingle_join.common_shingles(same.limit(0))[1:]] == [0, 0]


def test_joins_of_the_near_duplicate_stage_follow_texts(spark):
    """Rows of every join, as Spark counts them: as many as texts, pairs or fingerprints' segments, not as the texts' shingles (7,000 here)."""
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [runs.apply(i).executionId() for runs in [store.executionsList()] for i in range(runs.size())]
    before = set(ids())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingle_join.keep_first(docs).collect()) == list(range(0, 60, 2))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = []
    for run in set(ids()) - before:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    assert len(made) > 5 and 30 <= max(made) <= simhash.SEGMENTS * len(texts)
