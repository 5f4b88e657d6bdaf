"""Subword pieces: encoding by suffix-array matching, and decoding.

The units (a word with the blanks before it, or line breaks) of a batch that have
not been seen are concatenated and indexed by a suffix array; every piece of the
vocabulary is binary-searched in it, which gives the range of its occurrences; the
occurrences, sorted by position, are the edges of a lattice.  The lattice is then
relaxed: for unigram models towards the best-scoring path, for byte-pair models
in merge order (an edge is taken when both its halves are), because there the
best-scoring path is not the segmentation that the model defines.

Models are files read on the driver and broadcast; nothing is trained.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import chunks, flat_lists, handed_back
from terrapanel.llm.language import text_runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
# Stands for a blank mark that the text itself contains, which no piece matches.
_FOREIGN = 0x110001
# How a text falls into units. One blank before a word is left out of the unit's name.
_UNIT = re.compile(r" *[^ \n]+| +|\n[^ \n]*")
# Units kept from batch to batch, and units up to which merging runs for all units at once.
CACHE_UNITS, SHORT_UNIT = 400_000, 48


@dataclass
class PieceModel:
    pieces: list[str]
    scores: np.ndarray
    kind: str  # "bpe" or "unigram"
    unknown: int
    byte_ids: np.ndarray  # id of each byte's piece, or the unknown id
    matchable: np.ndarray  # ids of ordinary pieces
    points: np.ndarray = field(init=False)  # (matchable, longest) code points, padded with 0
    lengths: np.ndarray = field(init=False)
    priority: np.ndarray = field(init=False)  # by id: 0 for the best score, equal for equal scores
    spelt: tuple[np.ndarray, np.ndarray] = field(init=False)  # bytes of all pieces and their offsets

    def __post_init__(self):
        own = [self.pieces[i] for i in self.matchable]
        self.lengths = np.array([len(p) for p in own], dtype=np.int64)
        self.points = np.zeros((len(own), int(self.lengths.max(initial=1))), dtype=np.int64)
        for row, piece in enumerate(own):
            self.points[row, : len(piece)] = [ord(c) for c in piece]
        self.priority = np.unique(-self.scores, return_inverse=True)[1]
        byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i != self.unknown}
        ordinary = set(self.matchable.tolist())
        spelt = [byte_of.get(i, p.replace(chr(BLANK), " ").encode() if i in ordinary else b"") for i, p in enumerate(self.pieces)]
        spelt[self.unknown] = " ⁇ ".encode()
        self.spelt = np.frombuffer(b"".join(spelt), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelt])])


def load_model(path: str = MODEL) -> PieceModel:
    """A model file of the sentencepiece library, with byte fallback or without."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(found.serialized_model_proto())
    size = found.get_piece_size()
    kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
    byte_ids = np.full(256, found.unk_id(), dtype=np.int64)
    ordinary = []
    for i in range(size):
        if found.is_byte(i):
            byte_ids[int(found.id_to_piece(i)[3:-1], 16)] = i
        elif not (found.is_control(i) or found.is_unknown(i) or found.is_unused(i)):
            ordinary.append(i)
    scores = np.array([found.get_score(i) for i in range(size)])
    return PieceModel([found.id_to_piece(i) for i in range(size)], scores, kind, found.unk_id(), byte_ids, np.array(ordinary))


def suffix_array(points: np.ndarray, longest: int) -> np.ndarray:
    """Positions sorted by the ``longest`` characters that follow, or fewer where a 0 ends them.

    Characters are numbered densely and packed, as many as fit, into one integer;
    only suffixes that agree in those and go on beyond are sorted further.
    """
    n = len(points)
    table = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    table[points] = True
    code = (np.cumsum(table) - table[0])[points] * (points > 0)
    bits = max(1, int(table.sum()).bit_length())
    fit = 63 // bits
    padded = np.concatenate([code, np.zeros(longest + fit, dtype=np.int64)])

    def packed(skip: int, at: np.ndarray | None = None) -> np.ndarray:
        key, ended = np.zeros(n if at is None else len(at), dtype=np.int64), np.zeros(n if at is None else len(at), dtype=bool)
        for i in range(skip + fit):
            seen = padded[i : n + i] if at is None else padded[at + i]
            ended |= seen == 0
            if i >= skip:
                key = (key << bits) | np.where(ended, 0, seen)
        return key

    key = packed(0)
    order = np.argsort(key)
    skip = fit
    while skip < longest:
        ordered = key[order]
        tied = np.append(False, ordered[1:] == ordered[:-1])
        tied |= np.append(tied[1:], False)
        place = np.flatnonzero(tied & (ordered & ((1 << bits) - 1) > 0))
        if not len(place):
            break
        rank = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        at = order[place]
        order[place] = at[np.lexsort((packed(skip, at), rank[place]))]
        # From here on, ties are told by all that was compared.
        key = np.zeros(n, dtype=np.int64)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = rank[1:] != rank[:-1]
        later = packed(skip, order[place])
        same = np.zeros(n, dtype=bool)
        same[place[1:]] = (place[1:] == place[:-1] + 1) & (later[1:] == later[:-1])
        inside = np.zeros(n, dtype=bool)
        inside[place] = True
        fresh |= inside & ~same
        key[order] = (np.cumsum(fresh) << bits) | np.where(inside, padded[np.minimum(order + skip + fit - 1, n)] > 0, 0)
        skip += fit
    return order


def match_pieces(points: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of every occurrence of every piece."""
    longest = model.points.shape[1]
    present = np.zeros(0x110002, dtype=bool)
    present[points] = True
    present[0] = True
    able = np.flatnonzero(present[model.points].all(axis=1))
    if not len(able) or not len(points):
        return (np.zeros(0, dtype=np.int64),) * 3
    suffixes = suffix_array(points, longest)
    padded = np.concatenate([points, np.zeros(longest, dtype=points.dtype)])
    wanted, lengths = model.points[able], model.lengths[able]
    inside = np.arange(longest)[None, :] < lengths[:, None]

    def search(after: bool) -> np.ndarray:
        """For each piece, the first suffix not below it (or, ``after``, the first above all that start with it)."""
        low, high = np.zeros(len(able), dtype=np.int64), np.full(len(able), len(points), dtype=np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            seen = padded[suffixes[np.minimum(middle, len(points) - 1)][:, None] + np.arange(longest)[None, :]]
            gap = np.where(inside, seen - wanted, 0)
            first = (gap != 0).argmax(axis=1)
            sign = gap[np.arange(len(able)), first]
            below = (sign < 0) | (after & (sign == 0))
            open_ = low < high
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    begin, end = search(False), search(True)
    times = end - begin
    at = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return suffixes[at], np.repeat(lengths, times), np.repeat(model.matchable[able], times)


def _relax_path(lattice: np.ndarray, model: PieceModel, unit_of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Best-scoring path through every unit: ids by start position, -1 inside pieces, -2 for unknown characters.

    All units advance by one character a step.
    """
    longest, n = lattice.shape
    start, length = (x.astype(np.int64) for x in np.nonzero(lattice.T >= 0))
    ids, stop = lattice[length, start], start + length + 1
    poor = float(model.scores[model.matchable].min()) - 10.0
    best = np.full(n + len(offsets), -np.inf)
    node = np.arange(n) + unit_of  # each unit has one node more than characters
    first = offsets[:-1] + np.arange(len(offsets) - 1)
    best[first] = 0.0
    came, with_id = np.full(len(best), -1), np.full(len(best), -2)
    depth = np.arange(n) - offsets[unit_of]
    by_depth = np.argsort(depth, kind="stable")
    depth_at = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=-1) + 2))
    edge_order = np.argsort(depth[start], kind="stable")
    edge_at = np.searchsorted(depth[start][edge_order], np.arange(depth.max(initial=-1) + 2))
    for d in range(len(depth_at) - 1):
        here = by_depth[depth_at[d] : depth_at[d + 1]]
        own = edge_order[edge_at[d] : edge_at[d + 1]]
        source = np.concatenate([node[here], node[start[own]]])
        target = np.concatenate([node[here] + 1, node[start[own]] + stop[own] - start[own]])
        score = best[source] + np.concatenate([np.full(len(here), poor), model.scores[ids[own]]])
        piece = np.concatenate([np.full(len(here), -2), ids[own]])
        order = np.lexsort((-score, target))
        order = order[np.append(True, target[order][1:] != target[order][:-1])] if len(order) else order
        order = order[score[order] > best[target[order]]]
        best[target[order]], came[target[order]], with_id[target[order]] = score[order], source[order], piece[order]
    out = np.full(n, -1)
    at = offsets[1:] + np.arange(len(offsets) - 1)
    live = at > first
    while live.any():
        back = came[at[live]]
        owner = np.flatnonzero(live)
        out[back - owner] = with_id[at[live]]
        at[live] = back
        live = at > first
    return out


def _relax_merges(lattice: np.ndarray, model: PieceModel, unit_of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Merge order: of all edges whose two halves are taken, the best-scoring, leftmost first.

    Short units advance together, one merge a step; long ones by a queue each.
    """
    longest, n = lattice.shape

    def lookup(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = b - a
        return np.where(length <= longest, lattice[np.minimum(length, longest) - 1, a], -1)

    out = np.full(n, -1)
    long_units = np.flatnonzero(np.diff(offsets) > SHORT_UNIT)
    heads = np.flatnonzero(~np.isin(unit_of, long_units)) if len(long_units) else np.arange(n)
    tails = heads + 1
    big = np.int64(1) << np.int64(40)
    while len(heads):
        owner = unit_of[heads]
        piece = np.full(len(heads), -1)
        touching = owner[:-1] == owner[1:]
        piece[:-1][touching] = lookup(heads[:-1][touching], tails[1:][touching])
        rank = np.where(piece >= 0, model.priority[np.maximum(piece, 0)] * big + heads, np.int64(1) << np.int64(62))
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, begins)
        of = np.cumsum(np.append(True, owner[1:] != owner[:-1])) - 1
        idle = (least == np.int64(1) << np.int64(62))[of]
        done = np.flatnonzero(idle)
        out[heads[done]] = lookup(heads[done], tails[done])
        out[heads[done][out[heads[done]] < 0]] = -2
        chosen = np.flatnonzero((rank == least[of]) & ~idle)
        tails[chosen] = tails[chosen + 1]
        keep = ~idle
        keep[chosen + 1] = False
        heads, tails = heads[keep], tails[keep]
    for unit in long_units:
        lo, hi = int(offsets[unit]), int(offsets[unit + 1])
        at_length, at_start = np.nonzero(lattice[:, lo:hi] >= 0)
        at_edge = {(lo + a, lo + a + k + 1): int(lattice[k, lo + a]) for k, a in zip(at_length.tolist(), at_start.tolist())}
        ahead, behind = {i: i + 1 for i in range(lo, hi)}, {i + 1: i for i in range(lo, hi)}
        queue = [(int(model.priority[i]), a, a + 1, b) for (a, b), i in at_edge.items() if b - a == 2]
        heapq.heapify(queue)
        while queue:
            _, a, m, b = heapq.heappop(queue)
            if ahead.get(a) != m or ahead.get(m) != b:
                continue
            ahead[a], behind[b] = b, a
            del ahead[m]
            c, z = ahead.get(b), behind.get(a)
            if c is not None and (a, c) in at_edge:
                heapq.heappush(queue, (int(model.priority[at_edge[a, c]]), a, b, c))
            if z is not None and (z, b) in at_edge:
                heapq.heappush(queue, (int(model.priority[at_edge[z, b]]), z, a, b))
        for a, b in ahead.items():
            out[a] = at_edge.get((a, b), -2)
    return out


def units_of(text: str) -> list[str]:
    """The units of a text: blanks and the word after them, or a line break and the word after it.

    A word after one blank (or at the start, where encoding puts one) is named
    without it; all other units are named as they stand.
    """
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        return [u[1:] if u[0] == " " and len(u) > 1 and u[1] != " " else u for u in _UNIT.findall(" " + text)]
    if "\n" in text:
        return text.replace("\n", " \n").split(" ")
    return text.split(" ")


def segment(units: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the piece ids of each unit; characters no piece covers become their bytes' pieces."""
    units = [u if u[0] in " \n" else " " + u for u in units]
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    points = np.where(points == BLANK, _FOREIGN, np.where(points == 0x20, BLANK, points))
    # Units stand apart in the index by a mark that no piece contains.
    unit_of = np.repeat(np.arange(len(units)), sizes)
    apart = np.zeros(len(points) + len(units), dtype=np.int64)
    apart[np.arange(len(points)) + unit_of] = np.where(points == 0, _FOREIGN, points)
    start, length, ids = match_pieces(apart, model)
    start -= (np.cumsum(apart == 0) - (apart == 0))[start]
    # Sorted by position: one row for each length, one place for each start.
    lattice = np.full((model.points.shape[1], len(points)), -1, dtype=np.int32)
    lattice[length - 1, start] = ids
    relax = _relax_path if model.kind == "unigram" else _relax_merges
    taken = relax(lattice, model, unit_of, offsets)
    at = np.flatnonzero(taken != -1)
    value, place = taken[at], at
    strange = np.flatnonzero(value == -2)
    if len(strange):
        spelt = [(chr(p) if p != _FOREIGN else None) for p in points[place[strange]].tolist()]
        raw = "".join(units)
        many = [[int(model.byte_ids[b]) for b in raw[place[s]].encode("utf-8", "surrogatepass")] for s in strange] if (model.byte_ids != model.unknown).any() else [[model.unknown]] * len(spelt)
        times = np.ones(len(value), dtype=np.int64)
        times[strange] = [len(m) for m in many]
        value, place = np.repeat(value, times), np.repeat(place, times)
        value[value == -2] = np.concatenate([np.array(m) for m in many])
    counts = np.bincount(unit_of[place], minlength=len(units))
    return value.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _runs(units: list[str], limit: int = 250_000):
    """Runs of units that hold about ``limit`` characters together."""
    ends = np.cumsum([len(u) + 1 for u in units])
    lo = 0
    while lo < len(units):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit)))
        yield units[lo:hi]
        lo = hi


class Encoder:
    """Encodes batches of texts; units that were met before are looked up."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; NULL and empty texts have no ids."""
        if len(self.known) > CACHE_UNITS:
            self.clear()
        found = [units_of(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(found))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        strange = np.flatnonzero(at < 0)
        if len(strange):
            new = list({flat[i] for i in strange})
            for part in _runs(new):
                ids, offsets = segment(part, self.model)
                base = len(self.known)
                self.known.update(zip(part, range(base, base + len(part))))
                self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
                self.ids = np.concatenate([self.ids, ids])
            at[strange] = [self.known[flat[i]] for i in strange]
        length = self.offsets[at + 1] - self.offsets[at] if len(at) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(length)
        where = np.repeat(self.offsets[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate([[0], ends])
        per_text = np.concatenate([[0], np.cumsum([len(units) for units in found])]).astype(np.int64)
        return self.ids[where], upto[per_text]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, model: PieceModel) -> list[str]:
    """Texts of the id sequences, without the blank put before a text."""
    raw, at = model.spelt
    ids = ids.astype(np.int64)
    length = at[ids + 1] - at[ids]
    ends = np.cumsum(length)
    where = np.repeat(at[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    joined = raw[where].tobytes()
    upto = np.concatenate([[0], ends])[offsets].tolist()
    out = []
    for lo, hi in zip(upto[:-1], upto[1:]):
        text = joined[lo:hi].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def _sums(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    raw = memoryview(np.ascontiguousarray(ids, dtype="<i4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _encode(batches, model: PieceModel):
    encoder = Encoder(model)
    for batch in batches:
        for lo, texts in text_runs(batch.column("text"), 1_000_000):
            ids, offsets = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids, type=pa.int32()))
            same = [a == b for a, b in zip(decode_ids(ids, offsets, model), texts)]
            columns = [batch.column("id").slice(lo, len(texts)), lists, pa.array(_sums(ids, offsets), type=pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "ids_crc32", "round_trip"])


def encode(docs: DataFrame, model: PieceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ids_crc32, round_trip): the piece ids of every row's whole text; none for NULL and empty texts.

    ``ids_crc32`` is of the ids as little-endian 32-bit numbers; ``round_trip`` says that
    they were decoded and gave the text back.  Ids are the library's, but for one thing: a
    blank mark (U+2581) that a text itself contains becomes bytes, so that decoding returns
    the text exactly.  Repeated rows repeat, NULL ids are kept, an empty table gives an
    empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda it: handed_back(_encode(it, shared.value)), f"id {kind}, ids array<int>, ids_crc32 bigint, round_trip boolean")
    return out.withColumnRenamed("id", doc_id)


def _decode(batches, model: PieceModel):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids, offsets = flat_lists(table.column("ids"))
        texts = []
        for lo, hi in chunks(offsets):
            texts += decode_ids(ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, "decoded"])


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded``, the text of its ids; NULL ids have the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    named = rows.withColumnRenamed(ids, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    return named.mapInArrow(lambda it: _decode(it, shared.value), f"{schema}, decoded string").withColumnRenamed("ids", ids)


def report(docs: DataFrame, model_path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of every document."""
    out = encode(docs, load_model(model_path), doc_id, text)
    return out.select(doc_id, F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", "round_trip")
