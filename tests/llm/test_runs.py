"""Periodic runs against their definition, read word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from terrapanel.llm import runs


def plain_runs(words, exponent=4, least=6):
    """All (start, length, period): for each period the longest stretches that keep it, if no smaller period fits."""
    n, out = len(words), {}
    for period in range(1, n // exponent + 1):
        start = 0
        for i in range(period, n + 1):
            if i == n or words[i] != words[i - period]:
                if i - start >= max(least, exponent * period):
                    out.setdefault((start, i - start), period)
                start = i - period + 1
    return sorted((s, m, p) for (s, m), p in out.items())


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def phrases(dice, size=40):
    out = []
    for _ in range(dice.randint(0, size)):
        block = [dice.choice("abcd") for _ in range(dice.randint(1, 6))]
        out += (block * dice.randint(1, 9))[: dice.randint(1, 40)]
    return out


def test_runs_of_short_alphabets():
    dice = random.Random(1)
    for size in range(300):
        words = [dice.choice("ab"[: 1 + size % 2] + "c" * (size % 3)) for _ in range(size % 70)]
        symbols = [ord(w) - 96 for w in words]
        assert [tuple(r) for r in runs.maximal_runs(symbols).tolist()] == plain_runs(words)
        assert [tuple(r) for r in runs.maximal_runs(symbols, 2, 2).tolist()] == plain_runs(words, 2, 2)


@pytest.mark.parametrize("tree_words", [1, 200, 50_000])
def test_runs_of_texts(monkeypatch, tree_words):
    """Many texts at once, whose stretches share trees or not."""
    monkeypatch.setattr(runs, "TREE_WORDS", tree_words)
    dice = random.Random(2)
    texts = [[w.encode() for w in phrases(dice)] for _ in range(150)] + [[], [b"a"], [b"a"] * 6, [b"a"] * 5]
    for exponent, least in ((4, 6), (5, 8), (2, 2), (3, 4)):
        assert runs.word_runs(texts, exponent, least) == [plain_runs(t, exponent, least) for t in texts]


def test_common_extensions():
    dice = random.Random(3)
    symbols = [dice.randint(1, 3) for _ in range(400)] * 2
    n = len(symbols)
    tour, places = runs.euler_tour([*symbols, 0], 4)
    a = np.array([dice.randrange(n) for _ in range(3000)])
    b = np.array([dice.randrange(n) for _ in range(3000)])
    a, b = a[a != b], b[a != b]
    got = runs.LeastBetween(tour)(places[a], places[b])
    for i, j, length in zip(a, b, got, strict=True):
        assert symbols[i : i + length] == symbols[j : j + length]
        assert max(i, j) + length == n or symbols[i + length] != symbols[j + length]


def as_rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect())


def test_report(spark):
    dice = random.Random(4)
    rows = [(i, " ".join(phrases(dice, 12) if i % 3 else [dice.choice("abcdefghijklmnop") for _ in range(i % 90)])) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, " a a b\x0bc\x1cd"), (404, "é " * 50), (405, "a\r\na\ta  a a a a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(runs.report(docs)) == sorted(plain_report(*r) for r in rows)


def test_documents(spark):
    """All texts of the smallest table, up to 20,000 words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: r for r in as_rows(runs.report(docs))}
    checked = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        if len((text or "").split()) <= 1500:
            assert got[doc_id] == plain_report(doc_id, text)
            checked += 1
    assert checked > 100


def test_a_very_long_text(spark):
    """A period of 30,000 words four times, in 10 MB of other words and one long run of a single word."""
    block = [f"w{i % 29_989}x{i // 7 % 11}" for i in range(30_000)]
    words = [f"u{i}" for i in range(900_000)] + block * 4 + ["z"] * 50_000
    docs = spark.createDataFrame([(3, " ".join(words)), (4, "a")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[3]["runs"]] == [(900_000, 120_000, 30_000), (1_020_000, 50_000, 1)]
    assert len(got[3]["collapsed"].split()) == 930_001 and got[4]["runs"] == []


def test_odd_rows(spark, odd_docs, no_docs):
    got = runs.periodic_runs(odd_docs).collect()
    assert len(got) == 13 and set(got[0]["row"].asDict()) == set(odd_docs.columns) - {"text"}
    assert runs.report(odd_docs).count() == 13 and runs.report(no_docs).count() == 0
    assert {r["n_words"] for r in got if r["row"]["doc_id"] in (3, 4, 5)} == {0}
    # A missing id leaves the text as it is.
    texts = spark.createDataFrame([(None, "a b c d e f g h i j k l")] * 3, "doc_id long, text string")
    assert {r["collapsed_sha256"] for r in runs.report(texts).collect()} == {hashlib.sha256(b"a b c d e f g h i j k l").hexdigest()}
