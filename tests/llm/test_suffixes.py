"""Repeated byte strings against a count of all windows, and the refinement against sorted suffixes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import suffixes


def plain(texts, length):
    """(bytes, removed, spans, hash of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def found(spark, texts, length=200, ids=None):
    rows = [(i if ids is None else ids[i], t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = suffixes.report(docs, length=length).collect()
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def prose(dice, words):
    return " ".join("".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 8))) for _ in range(words))


def corpus(dice, texts=60, words=120):
    """Copies, near copies, passages at different places, periodic texts, characters of several bytes."""
    passage, line = prose(dice, 60), prose(dice, 12)
    out = [prose(dice, words) for _ in range(texts)]
    out += [out[0]] * 3 + [out[1].replace(" ", "  ", 1), out[2][:-30] + "END", "START" + out[3]]
    out += [f"{prose(dice, k)} {passage} {prose(dice, 7)} {line}" for k in range(1, 25)]
    out += [f"{prose(dice, 20)} {passage[k:]} {out[k][50:420]}" for k in range(9)]
    out += ["a" * 700, "ab" * 333, "abc" * 50, prose(dice, 9) * 30, "é" * 130 + "日本" * 90, "x" * 199, "y" * 200, "z" * 201]
    out += [None, "", " ", "word"]
    return out


@pytest.mark.parametrize("seed, bucket, piece", [(1, 1024, 1 << 20), (2, 2, 1 << 20), (3, 1024, 300), (4, 3, 1500)])
def test_against_all_windows(spark, monkeypatch, seed, bucket, piece):
    """With buckets sorted in tasks and split by their windows, and texts read whole and in pieces."""
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    texts = corpus(random.Random(seed))
    assert found(spark, texts) == sorted(plain(texts, 200))


@pytest.mark.parametrize("length", [1, 2, 7, 16, 33])
def test_short_windows(spark, length):
    dice = random.Random(length)
    texts = ["".join(dice.choice("ab é") for _ in range(dice.randint(0, 60))) for _ in range(40)] + [None, "c"]
    assert found(spark, texts, length) == sorted(plain(texts, length))


@pytest.mark.parametrize("bucket", [2048, 50, 2])
def test_one_passage_in_many_surroundings(spark, monkeypatch, bucket):
    """A long bucket of a passage that is met in part, whole, twice in a row, and cut off, by hundreds of texts."""
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    dice = random.Random(bucket)
    passage = prose(dice, 70)
    texts = []
    for k in range(300):
        a, b = dice.randint(0, 200), dice.randint(200, len(passage))
        texts.append(prose(dice, dice.randint(0, 9)) + passage[a:b] + ("" if k % 7 else passage[a:b]) + prose(dice, dice.randint(0, 30)))
    assert found(spark, texts) == sorted(plain(texts, 200))


def test_ids_do_not_matter(spark):
    """One id for all rows, no id at all, and equal rows: every row counts by itself."""
    texts = corpus(random.Random(5), texts=8)
    for ids in ([7] * len(texts), [None] * len(texts)):
        assert found(spark, texts, ids=ids) == sorted(plain(texts, 200))


def test_one_passage_in_a_third_of_all_texts(spark):
    dice = random.Random(6)
    passage = prose(dice, 50)
    texts = [f"{prose(dice, 20)} {passage} {prose(dice, 20)}" if i % 3 == 0 else prose(dice, 60) for i in range(3000)]
    assert found(spark, texts) == sorted(plain(texts, 200))


def test_a_very_long_text(spark):
    dice = random.Random(7)
    half = prose(dice, 150_000)
    texts = [half + " middle " + half[1000:], prose(dice, 100)]
    got = {r["n_bytes"]: r for r in suffixes.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    long = got[len(texts[0].encode())]
    assert long["n_removed"] == 2 * (len(half) - 1000) and long["n_spans"] == 2


def test_rows_and_spans(spark, odd_docs, no_docs):
    cut = suffixes.drop_repeats(odd_docs, length=20)
    got = cut.collect()
    assert len(got) == 13 and set(got[0]["row"].asDict()) == set(odd_docs.columns) - {"text"}
    assert all(r["kept"] == b"" and [tuple(s) for s in r["removed"]] == [(0, 79)] for r in got if r["row"]["doc_id"] in (1, 2))
    assert [bytes(r["kept"]) for r in got if r["row"]["doc_id"] == 9] == ["ééé ▁▁ 日本 \x00 x".encode()]
    assert suffixes.report(no_docs).count() == 0
    assert suffixes.report(odd_docs).count() == 13


def test_refinement_sorts_suffixes():
    dice = np.random.default_rng(1)
    for n, depth in ((1, 3), (50, 9), (400, 50), (1000, 200)):
        data = dice.integers(97, 99, n).astype(np.uint8)
        if n > 300:
            data[: n // 2] = data[n // 2 : n // 2 * 2]
        keys = [bytes(data[i : i + depth]).ljust(depth, b"\0") for i in range(n)]
        want = [sum(k < key for k in keys) for key in keys]
        assert suffixes.refine(data, depth).tolist() == want
