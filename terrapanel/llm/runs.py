"""Periodic runs of words, by suffix trees and Lyndon roots.

A run is a longest stretch of words with a smallest period, here of four periods and
six words at least.  Every run has a Lyndon root: a stretch of one period that is, for
the words' order or its reverse, the longest Lyndon word starting where it starts.  So
the longest Lyndon words are the candidates.  Each is extended to the right by the
longest common extension of two suffixes, looked up in the suffix tree (Ukkonen), and
to the left by that of the reversed words in the reversed words' tree.  The longest
common extension is the depth of the lowest common ancestor, the least depth on the
Euler tour between two leaves, found in constant time.

Trees are built where runs can be at all: three words inside a run recur at the
distance of its period, before or behind.  For periods up to each power of two, only
stretches in which every three words recur that near, as long as a run would be, are
kept; everything else is in no run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.columns import bound
from terrapanel.llm.common import chunks, mix

EXPONENT, LEAST = 4, 6
# Bytes of text looked at together, and words that share a tree (a longer stretch has one of its own).
PIECE, TREE_WORDS = 1 << 22, 50_000
_SPAN = 32
_NEVER = np.int64(1) << 60


def ukkonen(symbols: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
    """The suffix tree of ``symbols`` (below ``sigma``, the last one unique): first and end index of each node's edge, and the children.

    Node 0 is the root; a leaf's edge ends at ``len(symbols)``; the child of v whose
    edge begins with c is filed under ``v * sigma + c``.
    """
    n = len(symbols)
    first, end, link, child = [0], [0], [0], {}
    node = edge = length = open_suffixes = 0
    for i, c in enumerate(symbols):
        open_suffixes += 1
        made = 0
        while open_suffixes:
            if not length:
                edge = i
            key = node * sigma + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                made = node
            else:
                start = first[below]
                size = end[below] - start
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if symbols[start + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                split = len(first)
                child[key] = split
                child[split * sigma + c] = split + 1
                child[split * sigma + symbols[start + length]] = below
                first += [start, i]
                end += [start + length, n]
                link += [0, 0]
                first[below] = start + length
                if made:
                    link[made] = split
                made = split
            open_suffixes -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_suffixes + 1
    return first, end, child


def euler_tour(symbols: list[int], sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """(depths, places): the depths of the suffix tree's nodes along its Euler tour, children in order, and where each suffix's leaf is."""
    n = len(symbols)
    first, end, child = ukkonen(symbols, sigma)
    keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
    order = np.argsort(keys)
    kids = np.fromiter(child.values(), dtype=np.int64, count=len(child))[order].tolist()
    upto = np.cumsum(np.bincount(keys // sigma, minlength=len(first))).tolist()
    del child, keys, order
    turn = [0, *upto[:-1]]
    depth = [0] * len(first)
    tour, places = [], [0] * n
    stack = [0]
    while stack:
        v = stack[-1]
        at = depth[v]
        tour.append(at)
        i = turn[v]
        if i == upto[v]:
            stack.pop()
            continue
        turn[v] = i + 1
        w = kids[i]
        below = at + end[w] - first[w]
        if end[w] == n:
            places[n - below] = len(tour)
            tour.append(below)
        else:
            depth[w] = below
            stack.append(w)
    return np.array(tour, dtype=np.int32), np.array(places, dtype=np.int64)


class LeastBetween:
    """The least of a range of numbers in constant time: spans of ``_SPAN``, and a sparse table over their least ones."""

    def __init__(self, numbers: np.ndarray):
        room = -len(numbers) % _SPAN
        self.numbers = np.concatenate([numbers, np.full(room, np.iinfo(np.int32).max, dtype=np.int32)])
        spans = self.numbers.reshape(-1, _SPAN)
        self.head = np.minimum.accumulate(spans, axis=1).ravel()
        self.tail = np.minimum.accumulate(spans[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [spans.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            reach, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-reach], last[reach:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        left, right = lo // _SPAN, hi // _SPAN
        out = np.minimum(self.tail[lo], self.head[hi])
        whole = right - left - 1
        far = np.flatnonzero(whole > 0)
        level = np.floor(np.log2(whole[far])).astype(np.int64)
        for k in np.unique(level).tolist():
            at = far[level == k]
            table = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(table[left[at] + 1], table[right[at] - (1 << k)]))
        near = np.flatnonzero(left == right)
        if len(near):
            least = self.numbers[lo[near]].copy()
            for k in range(1, _SPAN):
                inside = lo[near] + k <= hi[near]
                least = np.where(inside, np.minimum(least, self.numbers[np.minimum(lo[near] + k, hi[near])]), least)
            out[near] = least
        return out


def _next_less(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one of lower rank, and the next one of higher rank, or the length."""
    n = len(rank)
    lower, higher = [n] * n, [n] * n
    low, high = [], []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            lower[low.pop()] = i
        low.append(i)
        while high and rank[high[-1]] < r:
            higher[high.pop()] = i
        high.append(i)
    return lower, higher


def maximal_runs(symbols: list[int], exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """(start, length, period) rows of all runs of ``exponent`` periods and ``least`` symbols, sorted by start and period.

    Symbols are positive integers.  A run's period is its smallest and neither
    neighbour extends it.
    """
    n = len(symbols)
    if n < least:
        return np.zeros((0, 3), dtype=np.int64)
    sigma = max(symbols) + 1
    tour, places = euler_tour([*symbols, 0], sigma)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[np.argsort(places)] = np.arange(n + 1)
    lower, higher = _next_less(rank[:n].tolist())
    begin = np.tile(np.arange(n), 2)
    after = np.array(lower + higher)
    keep = (after < n) & ((after - begin) * exponent <= n)
    begin, after = begin[keep], after[keep]
    right = LeastBetween(tour)(places[begin], places[after])
    del tour, places, rank, lower, higher
    tour, places = euler_tour([*symbols[::-1], 0], sigma)
    left = LeastBetween(tour)(places[n - begin], places[n - after])
    period = after - begin
    start, length = begin - left, left + period + right
    long = (length >= exponent * period) & (length >= least)
    return np.unique(np.stack([start, length, period], axis=1)[long], axis=0)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def candidates(names: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """Disjoint stretches (begin, end) of the words ``names`` that enclose all runs; text i is ``names[bounds[i]:bounds[i+1]]``."""
    n = len(names)
    if n < least or exponent < 4 or least < 5:
        return [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a >= least]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    word = mix(names.astype(np.uint64))
    key = mix(mix(word[:-2] + owner[:-2]) * np.uint64(31) + word[1:-1]) * np.uint64(31) + word[2:]
    whole = owner[:-2] == owner[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = np.where(same, np.diff(order), _NEVER)
    near = np.full(len(key), _NEVER)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    near = np.where(whole, near, _NEVER)
    marks = np.zeros(n + 1, dtype=np.int32)
    longest = int(np.diff(bounds).max())
    reach = 1
    while True:
        # Runs whose period is above half of ``reach`` and not above it.
        size = max(least, exponent * (reach // 2 + 1)) if reach > 1 else max(least, exponent)
        if size > longest:
            break
        begin, end = _stretches(near <= reach)
        enough = end - begin >= size - 2
        np.add.at(marks, begin[enough], 1)
        np.add.at(marks, end[enough] + 2, -1)
        reach *= 2
    # Stretches of different texts may touch; they are cut at the texts' ends.
    begin, end = _stretches(np.cumsum(marks[:-1]) > 0)
    out = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        cuts = bounds[np.searchsorted(bounds, a, side="right") : np.searchsorted(bounds, b, side="left")].tolist()
        out += [(x, y) for x, y in zip([a, *cuts], [*cuts, b], strict=True) if y - x >= least]
    return out


def word_runs(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    names = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=int(bounds[-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stretches = candidates(names, bounds, exponent, least)
    sizes = np.concatenate([[0], np.cumsum([b - a for a, b in stretches])]).astype(np.int64)
    for lo, hi in chunks(sizes, TREE_WORDS):
        number: dict[bytes, int] = {}
        symbols: list[int] = []
        origin = []
        for a, b in stretches[lo:hi]:
            text = int(np.searchsorted(bounds, a, side="right")) - 1
            begin = a - int(bounds[text])
            origin.append((len(symbols), text, begin))
            symbols += [number.setdefault(w, len(number) + 1) for w in texts[text][begin : begin + b - a]]
            symbols.append(-1)
        # Each stretch ends in a symbol of its own, which no run can hold.
        ends = [i for i, s in enumerate(symbols) if s < 0]
        for k, i in enumerate(ends):
            symbols[i] = len(number) + 1 + k
        if not symbols:
            continue
        places = np.array([o[0] for o in origin])
        for start, length, period in maximal_runs(symbols, exponent, least).tolist():
            at, text, begin = origin[int(np.searchsorted(places, start, side="right")) - 1]
            found[text].append((start - at + begin, length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(exponent: int, least: int):
    def task(batches):
        for batch in batches:
            column = batch.column("text")
            lengths = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in column], dtype=np.int64)
            for lo, hi in chunks(np.concatenate([[0], np.cumsum(lengths)]), PIECE):
                part = batch.slice(lo, hi - lo)
                texts = [(t or b"").split() for t in part.column("text").to_pylist()]
                found = word_runs(texts, exponent, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], _RUNS),
                        pa.array([collapse(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()),
                    ],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    return task


def periodic_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(row, n_words, runs, collapsed): every row as one value without its text, its runs, and the text without their repetitions.

    Words are what blanks and the characters 9 to 13 separate.  ``runs`` are sorted by
    start (a word's number) and period; ``collapsed`` (binary, UTF-8) are the words that
    are in no run behind its first period.  NULL text has no words; equal rows give
    equal rows; an empty table gives an empty table.  No row depends on another one.
    Memory is in proportion to the longest text: some hundred bytes for each of its
    words, and about a kilobyte for each word of its longest periodic stretch.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{n}`").alias(n) for n in docs.columns if n != text]).alias("row"), F.col(text).cast("binary").alias("text"))
    shape = T.StructType(keyed.select("row").schema.fields + T.StructType.fromDDL(f"n_words bigint, runs array<{_RUN}>, collapsed binary").fields)
    return keyed.mapInArrow(_scan(exponent, least), shape)


def with_periodic_tails(text: Column, key: Column) -> Column:
    """``text`` with, for one key in ten, the words from some word on replaced by a period of them, over and over."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def joined(words: Column) -> Column:
        n = F.size(words)
        start = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        plan = F.struct(start.alias("a"), (F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))).cast("int").alias("p"))
        # Words and plan are worked out once a text; the tail is one period, repeated and cut.
        return bound(plan, lambda s: F.array_join(F.concat(F.slice(words, F.lit(1), s["a"]), _repeated(F.slice(words, s["a"] + 1, s["p"]), n - s["a"])), " "))

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), bound(words, joined)).otherwise(text)


def _repeated(period: Column, length: Column) -> Column:
    times = F.ceil(length / F.greatest(F.size(period), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), length)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, one in ten with a periodic tail: n_runs, the longest run, and hashes of all runs and of the collapsed text.

    A NULL id has no remainder, so its text stays as it is.
    """
    key = F.col(doc_id)
    found = periodic_runs(docs.select(key.alias("doc_id"), with_periodic_tails(F.col(text), key).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", best)
    return best.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"), F.expr("-1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
