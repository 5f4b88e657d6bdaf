"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

1. Labellers look at a text and vote good, bad or nothing.
2. The votes of all documents are counted by pattern; there are at most 3 to the
   power of the labellers, whatever the corpus.  Expectation-maximisation over the
   counts estimates how each labeller votes on good and on bad texts, and with it
   the posterior of every pattern.
3. The posteriors of a bounded sample train a logistic scorer over hashed features
   of the text's make-up, which scores all documents, also those no labeller
   knows anything about.

No given label is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrapanel.llm.common import flat_lists, handed_back, mix
from terrapanel.llm.language import text_runs
from terrapanel.llm.linear import sample_of_distinct, sigmoid, take_rows

GOOD, BAD, NOTHING = 1, 0, 2
# Documents the scorer is trained on at most, chosen by a hash of the id among all.
TRAIN_DOCS = 12_000
FEATURES = 1 << 13
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.3, 1e-6
KEEP = 0.5

# Classes of characters.
_LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _STOP, _COMMA, _BANG, _QUOTE, _DASH, _SYMBOL, _OTHER = range(12)


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isupper():
            table[point] = _UPPER
        elif char.isalpha():
            table[point] = _LOWER
        elif char.isdigit():
            table[point] = _DIGIT
        elif char in "\n\r\x0b\x0c\u2028\u2029":
            table[point] = _BREAK
        elif char.isspace():
            table[point] = _BLANK
        elif point < 0x80:
            table[point] = _SYMBOL
    for chars, kind in ((".?", _STOP), (",;:()", _COMMA), ("!", _BANG), ("'\"", _QUOTE), ("-", _DASH)):
        for char in chars:
            table[ord(char)] = kind
    return table


_CLASSES: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    return _CLASSES


class Makeup:
    """Characters, tokens and their classes of a run of texts."""

    def __init__(self, texts: list[str]):
        self.rows = len(texts)
        self.points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.row = np.repeat(np.arange(self.rows), [len(t) + 1 for t in texts])
        self.kind = class_table()[self.points]
        solid = (self.kind != _BLANK) & (self.kind != _BREAK)
        first = solid & ~np.append(False, solid[:-1])
        last = solid & ~np.append(solid[1:], False)
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.token_row = self.row[self.start]
        number = np.cumsum(first) - 1
        place = np.arange(len(self.points)) - self.start[np.maximum(number, 0)] if len(self.start) else np.zeros(len(self.points))
        scrambled = np.where(solid, mix(self.points.astype(np.uint64) * np.uint64(0x10001) + place.astype(np.uint64) + np.uint64(1)), np.uint64(0))
        self.token = np.add.reduceat(scrambled, self.start) if len(self.start) else np.zeros(0, dtype=np.uint64)
        again = np.zeros(len(self.start), dtype=bool)
        again[1:] = (self.token[1:] == self.token[:-1]) & (self.token_row[1:] == self.token_row[:-1])
        self.again = again

    def per_row(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[chosen], minlength=self.rows).astype(float)

    def per_token(self, chosen: np.ndarray) -> np.ndarray:
        """How many chosen characters each token holds."""
        if not len(self.start):
            return np.zeros(0)
        upto = np.concatenate([[0], np.cumsum(chosen)])
        return upto[self.end] - upto[self.start]

    def tokens(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.token_row[chosen], minlength=self.rows).astype(float)


def votes(texts: list[str]) -> np.ndarray:
    """(texts, labellers): GOOD, BAD or NOTHING."""
    m = Makeup(texts)
    letters = m.per_row((m.kind == _LOWER) | (m.kind == _UPPER))
    solid = np.maximum(m.per_row((m.kind != _BLANK) & (m.kind != _BREAK)), 1)
    count = np.bincount(m.token_row, minlength=m.rows).astype(float)
    tokens = np.maximum(count, 1)
    symbols = m.per_token(m.kind == _SYMBOL)
    length = m.end - m.start
    distinct = np.zeros(m.rows)
    if len(m.token):
        order = np.lexsort((m.token, m.token_row))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (m.token[order][1:] != m.token[order][:-1]) | (m.token_row[order][1:] != m.token_row[order][:-1])
        distinct = np.bincount(m.token_row[order][new], minlength=m.rows).astype(float)
    ends = m.per_token(m.kind == _STOP) + m.per_token(m.kind == _COMMA) > 0
    upper = m.per_row(m.kind == _UPPER) / np.maximum(letters, 1)
    # What a text of its length would hold of distinct words if it were varied.
    varied = distinct / np.minimum(tokens, 3 * np.sqrt(tokens) + 5)

    def vote(bad: np.ndarray, good: np.ndarray, sure: np.ndarray) -> np.ndarray:
        return np.where(~sure, NOTHING, np.where(bad, BAD, np.where(good, GOOD, NOTHING)))

    long, some = count >= 20, count >= 4
    return np.stack(
        [
            vote(m.per_row(m.kind == _SYMBOL) / solid > 0.08, np.zeros(m.rows, bool), some),
            vote(m.tokens((symbols >= 2) & (symbols < length)) / tokens > 0.2, np.zeros(m.rows, bool), some),
            vote(upper > 0.5, (upper > 0) & (upper < 0.15), some),
            vote(m.per_row(m.kind == _BANG) / tokens > 0.3, np.zeros(m.rows, bool), some),
            vote(m.tokens(m.again) / tokens > 0.25, np.zeros(m.rows, bool), long),
            vote(varied < 0.35, np.zeros(m.rows, bool), long),
            vote(m.tokens(symbols == length) / tokens > 0.12, np.zeros(m.rows, bool), some),
            vote(m.tokens(ends) / tokens < 0.01, (m.tokens(ends) / tokens > 0.04) & (m.tokens(ends) / tokens < 0.6), count >= 40),
        ],
        axis=1,
    ).astype(np.int64)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return (vote * 3 ** np.arange(vote.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(labellers) % 3


@dataclass(frozen=True)
class LabelModel:
    prior: float  # share of good texts
    table: np.ndarray  # (class, labeller, vote) probabilities

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of a good text for each row of votes."""
        at = np.arange(vote.shape[1])
        good = np.log(self.prior) + np.log(self.table[1, at, vote]).sum(axis=1)
        bad = np.log(1 - self.prior) + np.log(self.table[0, at, vote]).sum(axis=1)
        return sigmoid(good - bad)


def estimate(vote: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from labellers that are right more often than wrong, which also says
    which of the two classes is the good one, and stays near that where there are
    few texts.
    """
    labellers = vote.shape[1]
    start = np.empty((2, labellers, 3))
    start[1] = [0.02, 0.38, 0.60]  # a good text: bad, good, nothing
    start[0] = [0.40, 0.10, 0.50]
    model = LabelModel(0.8, start)
    chosen = np.stack([vote == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        good = model.posterior(vote)
        table = np.stack([((counts * share)[:, None, None] * chosen).sum(axis=0) for share in (1 - good, good)])
        table = table + 4.0 * start
        table /= table.sum(axis=2, keepdims=True)
        prior = float(((counts * good).sum() + 4.0 * 0.8) / (counts.sum() + 4.0))
        done = abs(prior - model.prior) < 1e-9 and np.abs(table - model.table).max() < 1e-7
        model = LabelModel(prior, table)
        if done:
            break
    return model


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed sparse features: (feature, value, offsets by text).

    Runs of three character classes, and for each token its length, first and last
    class, whether symbols are inside and whether it repeats the one before; values
    are square roots of shares.
    """
    m = Makeup(texts)
    kind = m.kind.astype(np.uint64)
    inner = m.row[2:] == m.row[:-2]
    chars = mix(kind[:-2] * np.uint64(256) + kind[1:-1] * np.uint64(16) + kind[2:] + np.uint64(1 << 20))[inner]
    shape = np.minimum(m.end - m.start, 15).astype(np.uint64)
    for part in (kind[m.start], kind[m.end - 1], np.minimum(m.per_token(m.kind == _SYMBOL), 3).astype(np.uint64), m.again.astype(np.uint64)):
        shape = shape * np.uint64(16) + part
    again = np.where(m.again, np.uint64(1), np.uint64(2)) + np.uint64(1 << 50)
    feature, row, value = [], [], []
    for keys, owner in ((chars, m.row[:-2][inner]), (mix(shape + np.uint64(1 << 40)), m.token_row), (mix(again), m.token_row)):
        packed, times = np.unique(owner * FEATURES + (keys % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
        total = np.maximum(np.bincount(owner, minlength=m.rows), 1)
        feature.append(packed % FEATURES)
        row.append(packed // FEATURES)
        value.append(np.sqrt(times / total[packed // FEATURES]))
    feature, row, value = np.concatenate(feature), np.concatenate(row), np.concatenate(value)
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=m.rows))]).astype(np.int64)
    return feature[order], value[order], offsets


@dataclass
class LinearScorer:
    bias: float
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        feature, value, offsets = features(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        out = sigmoid(self.bias + np.bincount(owner, weights=self.weights[feature] * value, minlength=len(texts)))
        return np.where([bool(t.strip()) for t in texts], out, 0.0)


def train(feature: np.ndarray, value: np.ndarray, offsets: np.ndarray, target: np.ndarray, seed: int = 5) -> LinearScorer:
    """Logistic regression on soft labels, Adagrad, both classes weighted alike in sum."""
    scorer = LinearScorer(0.0, np.zeros(FEATURES))
    if not len(target):
        return scorer
    rng = np.random.default_rng(seed)
    past, past_b = np.full(FEATURES, 1e-6), 1e-6
    share = float(np.clip(target.mean(), 0.02, 0.98))
    scorer.bias = float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            where, owner = take_rows(offsets, offsets, rows)
            own, x = feature[where], value[where]
            p = sigmoid(scorer.bias + np.bincount(owner, weights=scorer.weights[own] * x, minlength=len(rows)))
            gap = (p - target[rows]) / len(rows)
            grad = np.bincount(own, weights=gap[owner] * x, minlength=FEATURES) + DECAY * scorer.weights
            past += grad**2
            past_b += gap.sum() ** 2
            scorer.weights -= RATE * grad / np.sqrt(past)
            scorer.bias -= RATE * gap.sum() / np.sqrt(past_b)
    return scorer


def _patterns(batches):
    held: dict[int, int] = {}
    for batch in batches:
        for _, run in text_runs(batch.column("text")):
            found, times = np.unique(pattern_of(votes(run)), return_counts=True)
            for p, n in zip(found.tolist(), times.tolist()):
                held[p] = held.get(p, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int32()), pa.array(list(held.values()), type=pa.int64())], names=["pattern", "n"])


def _examples(batches):
    for batch in batches:
        for lo, run in text_runs(batch.column("text")):
            feature, value, offsets = features(run)
            at = pa.array(offsets, type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("order").slice(lo, len(run)), pa.array(pattern_of(votes(run)), type=pa.int32()), pa.ListArray.from_arrays(at, pa.array(feature, type=pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, type=pa.float32()))],
                names=["order", "pattern", "feature", "value"],
            )


LABELLERS = 8


def fit_labels(docs: DataFrame, text: str = "text") -> LabelModel:
    """Accuracies of the labellers from the votes on all documents that hold a word."""
    rows = docs.where(F.col(text).rlike(r"\S")).select(F.col(text).alias("text"))
    counted = rows.mapInArrow(lambda it: handed_back(_patterns(it)), "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = sorted((r["pattern"], r["n"]) for r in counted.collect())
    patterns = np.array([p for p, _ in found], dtype=np.int64)
    return estimate(votes_of(patterns, LABELLERS), np.array([n for _, n in found], dtype=float))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = TRAIN_DOCS) -> tuple[LabelModel, LinearScorer]:
    """The label model from all documents, the scorer from a hashed sample of about ``max_docs`` of their ids and texts at most."""
    model = fit_labels(docs, text)
    rows = docs.where(F.col(text).rlike(r"\S")).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    chosen = sample_of_distinct(rows, ["id", "text"], max_docs).select(F.xxhash64("id", "text").alias("order"), "text")
    table = chosen.mapInArrow(_examples, "order bigint, pattern int, feature array<int>, value array<float>").toArrow().sort_by("order")
    feature, offsets = flat_lists(table.column("feature"))
    value, _ = flat_lists(table.column("value"))
    target = model.posterior(votes_of(table.column("pattern").to_numpy().astype(np.int64), LABELLERS))
    return model, train(feature.astype(np.int64), value.astype(float), offsets, target)


def _score(batches, scorer: LinearScorer):
    for batch in batches:
        for lo, run in text_runs(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(run)), pa.array(scorer.scores(run))], names=["id", "score"])


def predict(docs: DataFrame, scorer: LinearScorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: higher is better; NULL, empty and blank texts have 0.  Repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = StructType([StructField("id", docs.schema[doc_id].dataType), StructField("score", DoubleType())])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: handed_back(_score(it, shared.value)), schema).withColumnRenamed("id", doc_id)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, kept) of all documents."""
    _, scorer = fit(docs, doc_id, text)
    return predict(docs, scorer, doc_id, text).withColumn("kept", F.col("score") >= KEEP)
