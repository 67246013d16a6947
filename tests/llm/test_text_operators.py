"""Quality rules, language ID, URL filter, token counts and SentencePiece against brute force, with odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid, quality_rules, token_count, url_filter
from loomgraph.llm import sentencepiece_lattice as lattice
from loomgraph.llm.common import crc_fold
from loomgraph.llm.queries import op4_language_id, op7_token_counts, op8_sentencepiece_lattice, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", None, "a", 3), (5, "x y z " * 40, "en", None, 1), (5, "x y z " * 40, "en", None, 1),
    (6, "a\nb\na\n\n \na\n", "de", "b", 1), (None, "ünï cödé � " * 30, "fr", "b", 1), (7, "w" * 30_000, "en", "b", 1), (8, "### $$ & | <b>", "en", "a", 1), (9, "0123 456", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rng = random.Random(5)
    texts = [t for _, t, *_ in ODD] + ["".join(rng.choice("ab \n#\t") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert quality_rules.base_counts(t) == brute_counts(t)


def test_repeated_windows_of_large_ids():
    ids = np.array([10**9, 2 * 10**9, 3 * 10**9, 5, 10**9, 2 * 10**9, 3 * 10**9], dtype=np.int64)
    assert quality_rules.repeated_window_words(ids) == 6


def test_quality_verdicts(spark, odd):
    good = [(100 + i, "the cat sat on the mat and the dog ran over the hill to see " + f"w{i} " * 3 + " ".join(f"u{(i * 7 + j * j) % 89}" for j in range(60)), "en", "a", 1) for i in range(20)]
    bad = [(200 + i, " ".join(f"j{i}x{j}###" for j in range(80)), "en", "a", 1) for i in range(20)]
    docs = odd.unionByName(spark.createDataFrame(good + bad, DOC))
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(10)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    rows = {r.doc_id: r.v for r in docs.select("doc_id", quality_rules.verdicts(F.col("text"), rules).alias("v")).collect()}
    assert all(rows[100 + i].kept for i in range(20)) and not any(rows[200 + i].kept for i in range(20))
    assert rows[1].base_failed and rows[2].base_failed and not rows[7].kept
    # Brute force of the ratio, the scores and the threshold, with own counts of whole n-grams.
    bucket = lambda gram: int(quality_rules.ngram_buckets(gram, quality_rules.TokenHashes())[-1])

    def grams(text):
        tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]

    held = [d for d in range(100, 110) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert held
    raw, trusted = Counter(), Counter()
    for d, text, *_ in ODD + good + bad:
        raw.update(map(bucket, grams(text)))
        if d in range(100, 110) and d not in held:
            trusted.update(map(bucket, grams(text)))
    size = quality_rules.BUCKETS
    ratio = lambda b: math.log((trusted[b] + 1) / (trusted.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size))
    score = {d: float(np.mean([ratio(bucket(g)) for g in grams(t)])) if grams(t) else 0.0 for d, t, *_ in ODD[:4] + good + bad}
    assert {d: rows[d].score for d in score} == pytest.approx(score)
    low, middle = np.percentile([score[d] for d in held], [1, 50])
    assert rules.threshold == pytest.approx(middle - 3 * max(middle - low, 0.1))


def test_quality_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (odd, odd.limit(0)):
        rules = quality_rules.fit(docs, none)
        assert not rules.ratio.any() and rules.threshold == -math.inf
    clash = odd.withColumns({"n_words": F.lit(1), "kept": F.lit(2), "score": F.lit(3)})
    assert clash.select("*", quality_rules.verdicts(F.col("text"), rules).alias("v")).where("v.kept").count() == 0


def test_language_id_on_held_out_rows(spark):
    rows = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_odd_rows(spark, odd):
    model = langid.fit(odd, crc_fold("doc_id", 4) >= 0)
    rows = odd.select("doc_id", "text", langid.predictions(F.col("text"), model).alias("p")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p.lang_pred == langid.UNKNOWN) == (not letters) and r.p.rejected >= (not letters)
    empty = langid.fit(odd.limit(0), F.lit(True))
    assert odd.select(langid.predictions(F.col("text"), empty).alias("p")).where("p.lang_pred <> 'und' or p.score <> 0").count() == 0


def test_url_filter(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://b.net/x": ("b.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"), "http://netx.com/": ("netx.com", "/", None, "allow"), "https://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://x.org/fr/casino": ("x.org", "/fr/casino", "org/fr/", "allow"), "http://my-casino.com/": ("my-casino.com", "/", None, "block"), "http://casinox.com/": ("casinox.com", "/", None, "allow"),
        "http://free.com/": ("free.com", "/", None, "allow"), "http://free-bets.com/": ("free-bets.com", "/", None, "block"), "http://free.com/free": ("free.com", "/free", None, "allow"), "a://b?c://d/e": ("b", "", None, "allow"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    cases |= {"http://v14gr4.com/": ("v14gr4.com", "/", None, "block"), "http://x.com/" + "a" * 1_000_000: ("x.com", "/" + "a" * 1_000_000, None, "allow"), "": ("", "", None, "allow")}
    df = spark.createDataFrame([(u, u) for u in [*cases, None]], "url string, judged string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(cases) + 1 and {r.url: (r._judged.host, r._judged.path, r._judged.rule, r._judged.verdict) for r in rows} == cases
    assert all(r.host == 1 and r.rule == 2 and r.judged == r.url for r in rows)
    assert url_filter.judge(df.limit(0)).count() == 0
    own = url_filter.weighted(["alpha"], ["beta", "gamma"])
    asked = spark.createDataFrame([("a://x/alpha",), ("a://x/beta",), ("a://x/beta-gamma",), ("a://x/4lph4",)], "url string")
    assert [r.judged.verdict for r in url_filter.judge(asked, vocabulary=own).collect()] == ["block", "allow", "block", "block"]


def test_token_counts(spark, odd, library):
    rows = op7_token_counts(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.n_tokens == len(library.encode(r.text)) for r in rows)
    got = odd.select("text", token_count.token_counts(F.col("text"), tokenizer_path()).alias("n")).collect()
    assert all(r.n == len(library.encode(r.text or "")) for r in got)


def strange_texts(n=300):
    rng = random.Random(11)
    signs = list("aetnshrd   \n\t\r.,0") + ["▁", "é", "漢", "字", "😀", "\u0001", "▁▁", "the", "ing", "<s>", "</s>", "<0x0A>", "\u00a0"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(n)] + ["a" * 500, " " * 70, "x" + " " * 33 + "y", "ab" * 400]


def test_pieces_equal_the_library(library):
    counter = token_count.TokenCounter(tokenizer_path())
    encoder = lattice.Encoder(lattice.Pieces.of_model(tokenizer_path()), {})
    for t in strange_texts():
        assert encoder.encode(t).tolist() == library.encode(t)
        assert all(encoder.fold(r) == encoder.fold_long(r) for r in lattice.runs_of(t)[:20])
        assert counter.count(t) == len(library.encode(t))
        assert encoder.decode(encoder.encode(t)) == t.replace("▁", " ")


def test_lattice_equals_the_library(spark, library):
    pieces = lattice.Pieces.of_model(tokenizer_path())
    units = sorted({u for t in strange_texts(60) for r in lattice.runs_of(t) for u in lattice.units_of(r, pieces) if len(u) <= lattice.MAX_UNIT})
    encoder = lattice.Encoder(pieces, {})
    got = {r.unit: tuple(r.ids) for r in lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    assert got == {u: encoder.fold(u) for u in units}


def test_viterbi_fold(spark):
    rows = [("a", 10, -1.0), ("b", 11, -1.2), ("ab", 12, -1.9), ("ba", 13, -0.5), ("aba", 14, -3.5), ("c", 15, -1.0), ("bc", 16, -0.1)]
    pieces, table = lattice.Pieces.of_rows(rows, 20), {p: (i, s) for p, i, s in rows}

    def best(u):
        paths = {0: (0.0, [])}
        for e in range(1, len(u) + 1):
            options = [(paths[b][0] + table[u[b:e]][1], paths[b][1] + [table[u[b:e]][0]]) for b in range(e) if u[b:e] in table]
            paths[e] = max(options) if options else (paths[e - 1][0] - 1e6, paths[e - 1][1] + [20 + x for x in u[e - 1].encode()])
        return paths[len(u)]

    units = ["a", "ab", "aba", "abab", "babac", "abcab", "xab", "cc"]
    got = {r.unit: list(r.ids) for r in lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces, lattice.viterbi).collect()}
    score = {i: s for _, i, s in rows}
    for u in units:
        assert sum(score.get(i, -1e6) for i in got[u]) == pytest.approx(sum(score.get(i, -1e6) for i in best(u)[1]))


def test_encode_documents(spark, odd, library):
    rows = op8_sentencepiece_lattice(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    assert len(rows) == 200 and all(list(r.ids) == library.encode(r.was) and r.text == r.was for r in rows)
    got = lattice.encode(odd, tokenizer_path()).collect()
    assert len(got) == len(ODD) and sorted(map(len, (r.ids for r in got))) == sorted(len(library.encode(t or "")) for _, t, *_ in ODD)
    assert lattice.encode(odd.limit(0), tokenizer_path()).count() == 0
