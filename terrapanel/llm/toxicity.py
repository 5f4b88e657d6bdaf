"""Toxicity: a factorization machine over hashed terms.

    score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)   over a text's terms

The terms of a text are its words and the beginnings of its longer words, hashed.
The pairs let two terms that are harmless alone raise the score together, or one
take back what the other says, which no additive weight can.  Terms stay if they go
with the label, for or against it, among texts of like length; or if they do among the
texts that hold a term which speaks for it; or if they are the most frequent, whose
pairs alone may tell.  All others are left out, so that long texts don't gather noise.
Fitted on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrapanel.llm.common import chunks, crc_mod, flat_lists, handed_back, words
from terrapanel.llm.linear import bounded_sample, sample_of_distinct, sigmoid, take_rows
from terrapanel.session import cut_lineage

TERMS = 1 << 20
STEM = 4
# Labelled documents the machine is fitted on at most, chosen by a hash of the id.
TRAIN_DOCS = 12_000
FACTORS, STEPS, BATCH, RATE, DECAY = 8, 600, 256, 0.1, 1e-4
# How much more a missed toxic document counts than a clean one that is suspected.
POSITIVE = 3.0
# Chi-square of one degree of freedom at 0.001, and the frequent terms that stay whatever they tell.
TELLING, FREQUENT = 10.83, 64


def term_keys(text: Column) -> Column:
    """The distinct hashed terms: words, and the beginnings of words longer than ``STEM``."""
    found = F.array_distinct(F.coalesce(words(text), F.array().cast("array<string>")))
    stems = F.transform(F.filter(found, lambda w: F.length(w) > STEM), lambda w: F.xxhash64(F.lit("stem"), F.substring(w, 1, STEM)))
    every = F.concat(F.transform(found, lambda w: F.xxhash64(w)), stems)
    return F.array_distinct(F.transform(every, lambda h: h.bitwiseAND(F.lit(TERMS - 1).cast("long")).cast("int")))


def distinct_terms(values: np.ndarray, offsets: np.ndarray, slot_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashed terms, or kept slots where ``slot_of`` maps terms to those."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    terms = values.astype(np.int64) & (TERMS - 1)
    if slot_of is not None:
        terms = slot_of[terms]
        known = terms >= 0
        terms, rows = terms[known], rows[known]
    packed = np.unique(rows * TERMS + terms)
    rows, terms = packed // TERMS, packed % TERMS
    return terms, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))]).astype(np.int64)


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slot_of: np.ndarray  # hashed term -> row of weights, -1: none

    def logits(self, slots: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(logits, sums of factors) of texts given as (slot, owner) pairs."""
        sums = np.zeros((rows, self.factors.shape[1]))
        np.add.at(sums, owner, self.factors[slots])
        squares = np.bincount(owner, weights=(self.factors[slots] ** 2).sum(axis=1), minlength=rows)
        linear = np.bincount(owner, weights=self.weights[slots], minlength=rows)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slots, at = distinct_terms(values, offsets, self.slot_of)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return sigmoid(self.logits(slots, owner, len(at) - 1)[0])


def association(terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chi-square, excess) of every hashed term and the label among the chosen rows, by strata of like numbers of terms.

    Long texts hold more of everything; within a stratum (powers of two) that doesn't
    pass for association.  ``excess`` is how many more labelled texts hold the term
    than would by chance.
    """
    excess, spread = np.zeros(TERMS), np.zeros(TERMS)
    owner = np.repeat(np.arange(len(labels)), np.diff(offsets))
    stratum = np.frexp(np.diff(offsets))[1]
    for s in np.unique(stratum[rows]):
        inside = rows & (stratum == s)
        n, positive = float(inside.sum()), float(labels[inside].sum())
        if n < 2 or positive in (0.0, n):
            continue
        mine = inside[owner]
        seen = np.bincount(terms[mine], minlength=TERMS).astype(float)
        both = np.bincount(terms[mine], weights=labels[owner[mine]], minlength=TERMS)
        excess += both - seen * positive / n
        spread += seen * (n - seen) * positive * (n - positive) / (n * n * (n - 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, excess**2 / spread, 0.0), excess


def telling_terms(terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The hashed terms the machine may use: those that tell, by themselves or beside others, and the most frequent."""
    owner = np.repeat(np.arange(len(labels)), np.diff(offsets))
    seen = np.bincount(terms, minlength=TERMS)
    chi, excess = association(terms, offsets, labels, np.ones(len(labels), dtype=bool))
    tells = (chi >= TELLING) & (seen >= 2)
    # Beside a term that speaks for the label, others may confirm or take back what it says.
    speaks = tells & (excess > 0)
    beside = np.zeros(len(labels), dtype=bool)
    beside[owner[speaks[terms]]] = True
    near, _ = association(terms, offsets, labels, beside)
    among = np.bincount(terms[beside[owner]], minlength=TERMS)
    kept = tells | ((near >= TELLING) & (among >= 2))
    # Nothing tells of a term that all texts hold.
    common = np.minimum(seen, len(labels) - seen)
    frequent = np.argsort(-common, kind="stable")[:FREQUENT]
    kept[frequent[common[frequent] > 0]] = True
    return np.flatnonzero(kept)


def train(terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 3) -> FactorizationMachine:
    """Adagrad on the logistic loss, minibatches in seeded order."""
    kept = telling_terms(terms, offsets, labels) if len(labels) else np.zeros(0, dtype=np.int64)
    slot_of = np.full(TERMS, -1, dtype=np.int32)
    slot_of[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    rate = (labels.sum() + 0.5) / (len(labels) + 2.0)
    fm = FactorizationMachine(float(np.log(rate / (1 - rate))), np.zeros(max(len(kept), 1)), 0.05 * rng.standard_normal((max(len(kept), 1), FACTORS)), slot_of)
    if not len(kept):
        return fm
    slots = slot_of[terms]
    owner = np.repeat(np.arange(len(labels)), np.diff(offsets))
    known = slots >= 0
    at = np.concatenate([[0], np.cumsum(np.bincount(owner[known], minlength=len(labels)))])
    slots = slots[known]
    past_w, past_v, past_b = np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8), 1e-8
    for _ in range(max(1, -(-STEPS * BATCH // len(labels)))):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            where, mine = take_rows(slots, at, rows)
            own = slots[where]
            logit, sums = fm.logits(own, mine, len(rows))
            gap = (sigmoid(logit) - labels[rows]) * np.where(labels[rows] > 0, POSITIVE, 1.0) / len(rows)
            used, back = np.unique(own, return_inverse=True)
            grad_w = np.bincount(back, weights=gap[mine], minlength=len(used)) + DECAY * fm.weights[used]
            grad_v = np.zeros((len(used), FACTORS))
            np.add.at(grad_v, back, gap[mine][:, None] * (sums[mine] - fm.factors[own]))
            grad_v += DECAY * fm.factors[used]
            past_w[used] += grad_w**2
            past_v[used] += grad_v**2
            past_b += gap.sum() ** 2
            fm.weights[used] -= RATE * grad_w / np.sqrt(past_w[used])
            fm.factors[used] -= RATE * 0.3 * grad_v / np.sqrt(past_v[used])
            fm.bias -= RATE * gap.sum() / np.sqrt(past_b)
    return fm


def _collect_terms(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values, offsets = flat_lists(table.column("terms"))
        for lo, hi in chunks(offsets):
            terms, at = distinct_terms(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lists = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(terms, type=pa.int32()))
            part = table.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("order").combine_chunks(), part.column("label").combine_chunks(), lists], names=["order", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_docs: int = TRAIN_DOCS) -> FactorizationMachine:
    """Learn from the labelled documents; of more than ``max_docs`` labels a hashed sample.

    A document labelled more than once has its highest label; rows without id or
    label teach nothing.  Distinct terms of the sample reach the driver.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = cut_lineage(bounded_sample(own, F.col("_id"), max_docs))
    # The sample's ids: ``max_docs`` at most, give or take the hash; an id that stands for many texts doesn't add to its bound.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = sample_of_distinct(rows, ["_id", "_text"], max_docs, seed=2)
    rows = rows.select(F.xxhash64("_id", "_text").alias("order"), "label", term_keys(F.col("_text")).alias("terms"))
    table = rows.mapInArrow(_collect_terms, "order bigint, label int, terms array<int>").toArrow()
    table = table.sort_by("order")
    values, offsets = flat_lists(table.column("terms"))
    return train(values.astype(np.int64), offsets, table.column("label").to_numpy().astype(float))


def _score(batches, model: FactorizationMachine):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values, offsets = flat_lists(table.column("terms"))
        scores = [model.scores(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["id", "score"])


def predict(docs: DataFrame, model: FactorizationMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from the text alone; NULL and empty texts have the score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("id", docs.schema[doc_id].dataType), StructField("score", DoubleType())])
    rows = docs.select(F.col(doc_id).alias("id"), term_keys(F.col(text)).alias("terms"))
    return rows.mapInArrow(lambda it: handed_back(_score(it, shared.value)), schema).withColumnRenamed("id", doc_id)


def report(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents by a model that never saw the held-out fold."""
    model = fit(docs, labels.where(crc_mod(F.col(doc_id), folds) != held_out), "toxic", doc_id, text)
    out = predict(docs, model, doc_id, text)
    return out.select(doc_id, (crc_mod(F.col(doc_id), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
