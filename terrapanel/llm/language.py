"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased, everything but letters one blank; n-grams
of one to three characters are hashed to buckets.  Training counts buckets per
language inside tasks and sums them in Spark; the matrix of log probabilities
(languages x buckets) is broadcast; scoring gathers and sums its columns in numpy.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import chunks, crc_mod, mix

BUCKETS, GRAMS, SMOOTHING = 1 << 15, 3, 0.5
UNKNOWN = "und"
# Bytes of texts looked at together; a longer text is looked at by so many characters at a time.
_CHARS = 500_000


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for point in range(0x110000):
        table[point] = unicodedata.category(chr(point))[0] == "L"
    return table


_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    return _LETTER


def text_runs(column: pa.Array, limit: int = _CHARS):
    """(lo, texts) runs of rows that hold about ``limit`` bytes together; NULL is the empty text."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in chunks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), limit):
        yield lo, [text or "" for text in column.slice(lo, hi - lo).to_pylist()]


def long_gram_counts(text: str, step: int = _CHARS) -> tuple[np.ndarray, int]:
    """(n-grams in each bucket, number of letters) of one text, read piece by piece.

    The last characters of a piece go along with the next one, where only n-grams
    that end in new characters count, so that cuts change nothing.
    """
    counts, letters = np.zeros(BUCKETS, dtype=np.int64), 0
    held_code, held_letter, was_letter = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), True
    for lo in range(0, len(text) + 1, step):
        piece = text[lo : lo + step].lower() + ("\0" if lo + step > len(text) else "")
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            continue
        letter = letter_table()[points]
        keep = letter | np.append(was_letter, letter[:-1])
        was_letter = bool(letter[-1])
        code, letter = np.where(letter, points, 0).astype(np.uint64)[keep], letter[keep]
        letters += int(letter.sum())
        seen = len(held_code)
        code, letter = np.concatenate([held_code, code]), np.concatenate([held_letter, letter])
        for n, key, own in _gram_keys(code, letter):
            own[: max(seen - n + 1, 0)] = False
            counts += np.bincount((mix(key[own]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        held_code, held_letter = code[-(GRAMS - 1) :], letter[-(GRAMS - 1) :]
    return counts, letters


def _gram_keys(code: np.ndarray, letter: np.ndarray):
    """(n, key, whether its first or second character is a letter) of all n-grams, for each n."""
    for n in range(1, GRAMS + 1):
        if len(code) < n:
            break
        size = len(code) - n + 1
        key = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            key = key * np.uint64(0x110003) + code[i : size + i]
        yield n, key, letter[:size].copy() if n == 1 else letter[:size] | letter[1 : 1 + size]


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of lower-cased texts, and the number of letters of each row."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = letter_table()[points]
    code = np.where(letter, points, 0).astype(np.uint64)
    # Runs of blanks are one blank.
    keep = letter | np.append(True, letter[:-1])
    code, rows, letter = code[keep], rows[keep], letter[keep]
    buckets, owners = [], []
    for n, key, own in _gram_keys(code, letter):
        # The run stays in its row.
        own &= rows[: len(key)] == rows[n - 1 :]
        buckets.append((mix(key[own]) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(rows[: len(key)][own])
    return np.concatenate(buckets), np.concatenate(owners), np.bincount(rows[letter], minlength=len(low))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (buckets, languages)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its posterior, number of letters) per text."""
        if len(texts) == 1 and len(texts[0]) > _CHARS:
            counts, letters = long_gram_counts(texts[0])
            total, letters = (self.log_prior + counts @ self.log_prob)[None, :], np.array([letters])
            best = total.argmax(axis=1)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            return best, share.max(axis=1) / share.sum(axis=1), letters
        buckets, rows, letters = gram_buckets(texts)
        total = np.tile(self.log_prior, (len(texts), 1))
        for c in range(len(self.languages)):
            total[:, c] += np.bincount(rows, weights=self.log_prob[buckets, c], minlength=len(texts))
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        return best, share.max(axis=1) / share.sum(axis=1), letters


def _count(batches):
    held: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, run in text_runs(batch.column("text")):
            own = langs[lo : lo + len(run)]
            if len(run) == 1 and len(run[0]) > _CHARS:
                held[own[0]] = held.get(own[0], 0) + long_gram_counts(run[0])[0]
                docs[own[0]] = docs.get(own[0], 0) + 1
                continue
            buckets, rows, _ = gram_buckets(run)
            for lang in set(own):
                mine = own == lang
                held[lang] = held.get(lang, 0) + np.bincount(buckets[mine[rows]], minlength=BUCKETS)
                docs[lang] = docs.get(lang, 0) + int(mine.sum())
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        buckets, times = np.append(at, -1), np.append(counts[at], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets)), pa.array(buckets, type=pa.int32()), pa.array(times, type=pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows whose text and language are not NULL, whatever their ids.

    Tasks add up n-grams by language and bucket, so what is shuffled and what
    reaches the driver is one number for each of those.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counted = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    lang_of, bucket, n = (table.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    languages = sorted(set(lang_of))
    counts, docs_of = np.full((BUCKETS, len(languages)), SMOOTHING), np.zeros(len(languages))
    for c, name in enumerate(languages):
        own = (lang_of == name) & (bucket >= 0)
        counts[bucket[own], c] += n[own]
        docs_of[c] = n[(lang_of == name) & (bucket < 0)].sum()
    return LanguageModel(languages, np.log(docs_of / max(docs_of.sum(), 1)), np.log(counts / counts.sum(axis=0)))


def _predict(batches, model: LanguageModel):
    for batch in batches:
        for lo, run in text_runs(batch.column("text")):
            if model.languages:
                best, score, letters = model.scores(run)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, letters)]
                score = np.where(letters > 0, score, 0.0)
            else:
                names, score = [UNKNOWN] * len(run), np.zeros(len(run))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(run)), pa.array(names), pa.array(score, type=pa.float64())], names=["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    ``score`` is the posterior of the predicted language.  NULL texts, texts
    without a letter, and all texts if nothing was learnt, are ``und`` with score 0.
    Of languages that tie the first in alphabetical order is predicted.  Repeated rows
    give repeated rows, NULL ids are kept, and a text of any length is read by pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda it: _predict(it, shared.value), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", doc_id)


def report(docs: DataFrame, folds: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions of all documents by a model that never saw the held-out fold."""
    model = fit(docs.where(crc_mod(F.col(doc_id), folds) != held_out), text, lang)
    out = predict(docs, model, doc_id, text)
    return out.select(doc_id, (crc_mod(F.col(doc_id), folds) == held_out).alias("held_out"), "lang_pred", "score")
