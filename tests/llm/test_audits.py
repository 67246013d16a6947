"""Filter audit, source divergence and sharding against brute force, with odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import filter_audit, sharding, term_divergence
from loomgraph.llm.queries import op13_sharding

from .test_text_operators import DOC, ODD, SF, WORD

LABEL = "doc_id long, quality int, toxic int"
CLASH = {"part": "p", "mask": 99, "n": 7, "digest": "d", "term": "t", "shard": 5, "slot": 6, "size": "s", "range": 1, "k": 2, "row": 3, "sharded": 4}


def clashing(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


# Filter audit


def brute_fails(rows):
    """One set of failed filters for each (doc_id, text)."""
    least = {}
    for d, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t))) if bad}
        if t in least and (d is None or d > least[t]):
            fails.add("E")
        out.append(fails)
    return out


def brute_audit(docs, labels):
    """Applies the filters one after the other, document by document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    parts, out = defaultdict(list), {}
    for (d, _, lang), fails in zip(docs, brute_fails([x[:2] for x in docs]), strict=True):
        parts[lang or ""].append((d, fails))
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] for r in rows) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in rows}
    assert len(got) == len(rows)
    return got


def test_filter_audit_equals_applying_the_filters(spark):
    rng = random.Random(1)
    words = ["a", "b", "Word", "SHOUT", "x#", "ünï"] + [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 6, 400])]) for _ in range(rng.choice([0, 3, 190, 250]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(200)] + [(None, texts[0], "en"), (None, "of no id", "en"), (7, "again", "fr"), (7, "again", "fr"), (8, None, "fr"), (9, "", "fr"), (10, "Long " * 200_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10, 1, 0)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string")).repartition(5)
    marks = spark.createDataFrame(labels, LABEL).withColumn("n", F.lit(3))
    assert audited(filter_audit.audit(df, marks, F.col("lang"))) == brute_audit(docs, labels)


def test_filter_audit_of_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1)], LABEL)
    assert audited(filter_audit.audit(odd, labels, F.col("lang"))) == brute_audit([r[:3] for r in ODD], [(1, 1, 0), (5, None, 1)])
    assert filter_audit.audit(odd.limit(0), labels, F.col("lang")).count() == 0
    got = filter_audit.audit(odd, labels.limit(0), F.lit("all"), {"X": F.col("text").isNull()}, "Y").collect()
    assert {(r.filter_order, r.step) for r in got} == {("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(odd, labels, F.col("lang"), {"E": F.lit(True)})


def test_gray_code_states_are_sums_over_cells():
    counts = np.random.default_rng(0).integers(0, 99, (3, 32))
    states = filter_audit.survivors(counts, 5)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


# Source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(docs, shown=200):
    hits, of_docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        hits[lang or "", source or ""].update(terms)
        of_docs[lang or ""].update(set(terms))
    utf8 = lambda s: s.encode()
    for lang, source in groups:
        kept = [t for t, n in of_docs[lang].items() if n >= 3]
        sources = [s for at, s in groups if at == lang]
        n = {s: sum(hits[lang, s][t] for t in kept) for s in sources}
        p = lambda count, total: 1 + 10**9 * (count + 1) // (total + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        mine = {t: p(hits[lang, source][t], n[source]) for t in kept}
        pairs = [(s, sum(f(mine[t], p(hits[lang, s][t], n[s])) for t in kept)) for s in sources if s != source]
        terms = []
        for t in kept:
            q = p(sum(hits[lang, s][t] for s in sources), sum(n.values()))
            if hits[lang, source][t] and mine[t] > q:
                terms.append((t, f(mine[t], q)))
        for part, rows, most in (("pair", pairs, None), ("term", terms, shown)):
            rows.sort(key=lambda r: (-r[1], utf8(r[0])))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def diverging(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("chunk", [40, 4 << 20])
def test_divergence_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(term_divergence, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(term_divergence, "BROADCAST_GROUPS", 0 if chunk == 40 else 20_000)
    rng = random.Random(3)
    letters = ["a", "B", "é", "ß", "Ж", "𝔘", "zz", "Ab"]
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31, 33, 60, 70, 150, 400) for _ in range(3)]
    docs = []
    for i in range(300):
        text = rng.choice([" ", "-", "\n1"]).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(rng.randrange(12)))
        docs.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    docs += [(None, "en", "void"), ("", "", "a"), ("only once here", "xx", "a"), ("", "xx", "b"), ("x " * 50_000 + "y" * 30_000, "en", "a"), ("İstanbul ISTANBUL", "de", "b"), docs[0], docs[0], docs[0]]
    df = clashing(spark.createDataFrame(docs, "text string, lang string, source string")).repartition(5)
    assert diverging(term_divergence.divergence(df)) == brute_divergence(docs)


def test_divergence_of_odd_and_empty_tables(spark, odd, monkeypatch):
    assert diverging(term_divergence.divergence(odd)) == brute_divergence([(t, lang, s) for _, t, lang, s, _ in ODD])
    assert term_divergence.divergence(odd.limit(0)).count() == 0
    monkeypatch.setattr(term_divergence, "SHOWN_TERMS", 2)
    docs = [("a b c d e f", "en", "s")] * 3 + [("a b", "en", "t")] * 9
    assert diverging(term_divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string"))) == brute_divergence(docs, 2)


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 2**64 - 1, 500, np.uint64, endpoint=True), rng.integers(0, 3, 500).astype(np.uint32)
    one[::7] = one[0]
    assert (term_divergence.radix_order([two, one]) == np.lexsort((one, two))).all()
    assert not len(term_divergence.radix_order([np.empty(0, np.uint64)]))


def test_shares_are_exact_for_large_counts(spark):
    df = spark.createDataFrame([(10**17, 10**18, 10**9)], "n long, total long, kept long")
    assert df.select(term_divergence.share("n", "total", "kept")).first()[0] == 1 + 10**9 * (10**17 + 1) // (10**18 + 10**9)


# Sharding


def held(df):
    """Rows of (size, shard, slot) with id and text, after the checks that hold for any input."""
    rows = [(r.doc_id, r.text, *r[-1]) for r in df.collect()]
    slots = defaultdict(list)
    for _, text, size, shard, slot in rows:
        assert size == len((text or "").encode()) + 1 and 0 <= shard < sharding.SHARDS
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def by_shard(rows):
    out = Counter()
    for r in rows:
        out[r[3]] += r[2]
    return [out[i] for i in range(sharding.SHARDS)]


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = held(sharding.shards(docs))
    assert Counter(r[:2] for r in rows) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sizes = by_shard(rows)
    assert max(sizes) <= 1.04 * sum(sizes) / 8 and min(sizes) >= 0.96 * sum(sizes) / 8
    of_text = defaultdict(set)
    for r in rows:
        of_text[r[1]].add(r[3])
    assert sum(len(s) > 1 for s in of_text.values()) <= 7
    again = held(sharding.shards(docs))
    assert sorted(rows, key=repr) == sorted(again, key=repr)


@pytest.mark.parametrize("levels", [1, 5])
def test_hot_texts_and_repeated_rows_are_subdivided(spark, monkeypatch, levels):
    monkeypatch.setattr(sharding, "RANGES_A_SHARD", 32)
    monkeypatch.setattr(sharding, "MOST_PIECES", 64)
    monkeypatch.setattr(sharding, "STRIDE", 130)
    monkeypatch.setattr(sharding, "LEVELS", levels)
    docs = [(i, "the same text again and again") for i in range(3000)] + [(5, "one row")] * 2000 + [(None, None)] * 500 + [(i, f"text {i} " * (i % 9)) for i in range(4000)]
    rows = held(sharding.shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)))
    assert Counter(r[:2] for r in rows) == Counter(docs)
    sizes = by_shard(rows)
    if levels > 1:
        assert max(sizes) <= 1.1 * sum(sizes) / 8 and min(sizes) >= 0.9 * sum(sizes) / 8


def test_shards_of_odd_and_empty_tables(spark, odd, tmp_path):
    clash = clashing(odd)
    out = sharding.shards(clash)
    assert out.columns == [*clash.columns, "_sharded"]
    assert Counter(r[:2] for r in held(out)) == Counter(r[:2] for r in ODD)
    assert sharding.shards(odd.limit(0)).count() == 0
    giant = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y")] + [(i, f"w{i}") for i in range(3, 40)], "doc_id long, text string")
    assert len(held(sharding.shards(giant))) == 39
    sharding.write_shards(odd, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(ODD) and back.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").isEmpty()


def test_sharding_query(spark):
    rows = op13_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)


def test_sharding_has_no_python_in_its_plan(spark):
    plan = op13_sharding(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
