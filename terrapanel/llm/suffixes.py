"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

A *window* is ``length`` bytes of one text.  Suffixes are put into buckets by their
first ``GRAM`` bytes, and buckets of more than one suffix are refined by sorting their
members on the bucket pointers of later offsets; pointers of refined buckets are used
again, so that each round reaches twice as far, until buckets agree in ``length`` bytes.
A window is repeated if its bucket holds another one.

Which bucket decides about a window: the one of the least named gram inside it (the
leftmost of equals), its *anchor*.  Equal windows have equal anchors at equal places,
so only buckets of anchors, about one position in eighty, cross the network.  The
windows of one anchor are a stretch of text, its *region*, and a bucket falls into
three cases:

* one region, once: nothing in it is repeated (most buckets);
* one region, several times: all of it is;
* several regions: they are sorted against each other byte by byte, as above.  Buckets
  too large for a task are refined by joins: their windows fall into ranges by where
  the anchor lies in them, all windows of a range share a core, and only members whose
  core others have too go on to the halves of the range.

All tables here grow with the texts, so none is broadcast, at any size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import chunks, mix, whole_groups
from terrapanel.session import cut_lineage, ensure_checkpoint_dir

LENGTH, GRAM = 200, 40
# Bytes looked at together in a task, and regions of one bucket that are sorted in one task.
PIECE, BUCKET = 1 << 19, 2048

_PLACE = np.uint64((1 << 22) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pointers of grams that begin like ``a`` and go on like ``b``."""
    x = a * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _packed(data: np.ndarray, width: int = 8) -> np.ndarray:
    """Each position's first ``width`` (up to 8) bytes as one integer, the first byte highest."""
    n = len(data) - width + 1
    room = np.concatenate([data, np.zeros(15, dtype=np.uint8)])
    out = np.empty(-(-n // 8) * 8, dtype=np.uint64)
    for k in range(8):
        out[k::8] = room[k : k + len(out)].view(">u8")
    return out[:n] >> np.uint64(8 * (8 - width))


def gram_pointers(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The names of all grams of ``size`` bytes, from those of eight upwards, each reused at a later offset."""
    if len(data) < size:
        return np.zeros(0, dtype=np.uint64)
    width = min(size, 8)
    names = mix(_packed(data, width))
    while width < size:
        step = min(width, size - width)
        names = _paired(names[: len(names) - step], names[step:])
        width += step
    return names


def _window_names(grams: np.ndarray, at: np.ndarray, length: int, size: int, salt: int) -> np.ndarray:
    """Names of the windows at ``at``, from the names of the grams that cover them."""
    out = np.full(len(at), salt, dtype=np.uint64) * _ODD
    for offset in [*range(0, length - size, size), length - size]:
        out = _paired(out, grams[at + offset])
    return out


def _gram(length: int) -> int:
    return max(1, min(GRAM, length // 2))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Regions of the texts ``data[bounds[i]:bounds[i+1]]``: owner, start, windows, lead, times, anchor, region.

    ``lead`` bytes lie before the anchor.  A region that follows itself, as in periodic
    text, is one entry with its ``times``; ``windows`` are those of one.
    """
    size = _gram(length)
    names = gram_pointers(data, size)
    width = length - size + 1
    count = len(data) - length + 1
    if count <= 0:
        return {n: np.zeros(0, dtype=np.int64) for n in ("owner", "start", "windows", "lead", "times")} | {n: np.zeros(0, dtype=np.uint64) for n in ("anchor", "region")}
    least = (names & ~_PLACE) | np.arange(len(names), dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    place = (least & _PLACE).astype(np.int64)
    # Windows inside one text.
    inside = np.zeros(count + 1, dtype=np.int8)
    first, last = bounds[:-1], bounds[1:] - length + 1
    fits = last > first
    np.add.at(inside, first[fits], 1)
    np.add.at(inside, last[fits], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    turns = np.append(True, place[1:] != place[:-1])
    begins = inside & (turns | np.append(True, ~inside[:-1]))
    ends = inside & (np.append(turns[1:], True) | np.append(~inside[1:], True))
    start, final = np.flatnonzero(begins), np.flatnonzero(ends)
    at = place[start]
    region = _paired(_window_names(names, start, length, size, 1), _window_names(names, final, length, size, 2))
    region = _paired(region, ((final - start) * 65536 + (at - start)).astype(np.uint64))
    owner = np.searchsorted(bounds, start, side="right") - 1
    anchor = names[at]
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (anchor[1:] == anchor[:-1]) & (region[1:] == region[:-1]) & (owner[1:] == owner[:-1]) & (start[1:] == final[:-1] + 1)
    head = np.flatnonzero(~again)
    times = np.diff(np.append(head, len(start)))
    return {"owner": owner[head], "start": start[head], "windows": (final - start + 1)[head], "lead": (at - start)[head], "times": times, "anchor": anchor[head], "region": region[head]}


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary column without NULLs."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


_REGION = "ka long, kb int, start int, windows int, lead int, times int, anchor long, region long"


def _scan(length: int):
    def task(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column("text"))
            ka, kb = batch.column("ka").to_numpy(), batch.column("kb").to_numpy()
            for lo, hi in chunks(offsets, PIECE):
                # A text longer than a piece is read in pieces that overlap, so that each window is in one.
                for begin in range(offsets[lo], max(offsets[hi] - length + 1, offsets[lo] + 1), PIECE if hi - lo == 1 else 1 << 62):
                    end = offsets[hi] if hi - lo > 1 else min(offsets[hi], begin + PIECE + length - 1)
                    bounds = offsets[lo : hi + 1] - begin if hi - lo > 1 else np.array([0, end - begin])
                    found = anchors(data[begin:end], bounds, length)
                    owner = found["owner"] + lo
                    shift = begin - offsets[owner]
                    small = [pa.array(x.astype(np.int32)) for x in (found["start"] + shift, found["windows"], found["lead"], found["times"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ka[owner]), pa.array(kb[owner]), *small, pa.array(found["anchor"].view(np.int64)), pa.array(found["region"].view(np.int64))],
                        names=["ka", "kb", "start", "windows", "lead", "times", "anchor", "region"],
                    )

    return task


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of all positions: where, among all suffixes sorted by ``depth`` bytes, the equals of each begin.

    The first buckets hold positions of equal first bytes; in each round, the members
    of every bucket that has several are sorted by the pointers a round's reach further on.
    Suffixes shorter than ``depth`` are compared as if zeros followed.
    """
    n = len(data)
    width = min(8, depth)
    first = _packed(np.concatenate([data, np.zeros(width, dtype=np.uint8)]), width)[:n]
    order = np.argsort(first, kind="stable")
    begins = np.append(True, first[order][1:] != first[order][:-1])
    pointer = np.empty(n, dtype=np.int64)
    pointer[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    while width < depth:
        step = min(width, depth - width)
        several = np.bincount(pointer, minlength=n)[pointer] > 1
        at = np.flatnonzero(several)
        if not len(at):
            break
        later = np.where(at + step < n, pointer[np.minimum(at + step, n - 1)], -1)
        order = np.lexsort((later, pointer[at]))
        at, later = at[order], later[order]
        bucket = pointer[at]
        new = np.append(True, bucket[1:] != bucket[:-1])
        inner = new | np.append(True, later[1:] != later[:-1])
        rank = np.arange(len(at))
        pointer[at] = bucket + np.maximum.accumulate(np.where(inner, rank, 0)) - np.maximum.accumulate(np.where(new, rank, 0))
        width += step
    return pointer


def _layout(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, windows, times) of a table of regions."""
    data, offsets = _bytes_of(table.column("bytes").combine_chunks() if isinstance(table.column("bytes"), pa.ChunkedArray) else table.column("bytes"))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], table.column("windows").to_numpy().astype(np.int64), table.column("times").to_numpy()


def _window_places(offsets: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region, position) of every window of regions laid out one after the other."""
    owner = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return owner, offsets[:-1][owner] + inner


def _sorted_buckets(length: int):
    """Regions, bucket by bucket, into the stretches of theirs that are repeated: (ka, kb, from, to), ``to`` exclusive."""

    def settled(table: pa.Table) -> pa.RecordBatch:
        data, offsets, windows, times = _layout(table)
        owner, at = _window_places(offsets, windows)
        pointer = refine(data, length)[at]
        # Equal windows have one anchor, so buckets don't mix; each window counts as often as its region occurs.
        weight = np.bincount(pointer, weights=times[owner])
        repeated = (weight[pointer] >= 2) & (times[owner] == 1)
        starts = repeated & ~np.append(False, repeated[:-1] & (owner[1:] == owner[:-1]))
        stops = repeated & ~np.append(repeated[1:] & (owner[1:] == owner[:-1]), False)
        who = owner[starts]
        base = table.column("start").to_numpy()[who] - offsets[:-1][who]
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("ka").to_numpy()[who]), pa.array(table.column("kb").to_numpy()[who]), pa.array(base + at[starts]), pa.array(base + at[stops] + length)],
            names=["ka", "kb", "lo", "hi"],
        )

    def task(batches):
        held, size = [], 0
        for table in whole_groups(batches, ["anchor"]):
            held.append(table)
            size += table.nbytes
            if size > PIECE:
                yield settled(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
        if held:
            yield settled(pa.concat_tables(held).combine_chunks())

    return task


def _halved(members: DataFrame, length: int) -> DataFrame:
    """(ka, kb, lo, hi): the stretches of regions of large buckets that are repeated.

    A window's range is told by the bytes between its start and the anchor.  All windows
    of a range share the bytes between the last start and the first end, their core; a
    member without another of the same core is done.  Members equal in all their windows
    of the range are repeated there; one of them stays to be met by others.  The rest is
    looked at by halves of the range, down to single windows, so each round is a few
    rows a member, counted before the shuffle, and no bucket is ever in one task.
    """
    width = length - _gram(length) + 1
    step = -(-width // 4)
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(min(a + step, width) - 1).alias("b")) for a in range(0, width, step)])
    kept = ["ka", "kb", "start", "windows", "lead", "anchor", "bytes"]
    own = F.filter(ranges, lambda r: (r["a"] <= F.col("lead")) & (r["b"] > F.col("lead") - F.col("windows")))
    rows = members.select(*kept, F.xxhash64("ka", "kb", "start").alias("who"), F.col("times").alias("n"), (F.col("times") > 1).alias("met"), F.explode(own).alias("r")).select("*", "r.*").drop("r")
    core, span = ["c1", "c2"], ["c1", "c2", "p", "q", "s1", "s2"]
    out = []
    while step:
        step = 0 if step == 1 else -(-step // 2)
        p, q = F.greatest("a", F.col("lead") - F.col("windows") + 1), F.least("b", "lead")
        rows = rows.withColumns({"p": p, "q": q})
        inner = F.expr(f"substring(bytes, lead - a + 1, {length} - b + a)")
        outer = F.expr(f"substring(bytes, lead - q + 1, {length} - p + q)")
        names = {f"c{k}": F.xxhash64(F.lit(k), F.col("anchor"), F.col("a"), inner) for k in (1, 2)} | {f"s{k}": F.xxhash64(F.lit(k), outer) for k in (1, 2)}
        rows = cut_lineage(rows.withColumns(names))
        spans = cut_lineage(rows.groupBy(*span).agg(F.sum("n").alias("all"), F.min("who").alias("one")))
        shared = spans.groupBy(*core).agg(F.sum("all").alias("n"), F.count_if(F.col("all") == 1).alias("open")).where("n > 1 and open > 0").select(*core)
        told = rows.join(spans.hint("merge"), span)
        out.append(told.where("all > 1 and not met").select("ka", "kb", (F.col("start") + F.col("lead") - F.col("q")).cast("long").alias("lo"), (F.col("start") + F.col("lead") - F.col("p") + length).cast("long").alias("hi")))
        if not step:
            break
        left = told.where("all = 1 or who = one").join(shared.hint("merge"), core, "left_semi")
        middle = F.least(F.col("a") + step, F.col("b") + 1)
        halves = F.array(F.struct(F.col("a").alias("a"), (middle - 1).alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
        halves = F.filter(halves, lambda r: (r["a"] <= r["b"]) & (r["a"] <= F.col("q")) & (r["b"] >= F.col("p")))
        rows = cut_lineage(left.select(*kept, "who", F.col("all").alias("n"), (F.col("all") > 1).alias("met"), F.explode(halves).alias("r")).select("*", "r.*").drop("r"))
        if rows.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def row_keys(doc_id: str, text: str) -> list[Column]:
    """96 bits that stand for a row of the input, of its text and of its id and text; equal rows share them."""
    return [F.xxhash64(F.lit(12), F.col(text)).alias("ka"), F.shiftright(F.xxhash64(F.col(doc_id), F.col(text)), 32).cast("int").alias("kb")]


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, where its columns take the least room."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(ka, kb, spans): byte ranges (lo, hi) of each row's text that lie in repeated windows; rows without any are left out.

    ``ka`` and ``kb`` are ``row_keys``; spans may touch and overlap, and are not sorted.
    """
    rows = docs.where(F.octet_length(text) >= length).select(*row_keys(doc_id, text), F.col(text).cast("binary").alias("text"))
    # Twice from the texts: to count the buckets, and to keep the places of those that hold several.
    found = rows.mapInArrow(_scan(length), _REGION)
    buckets = found.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("region").alias("least"), F.max("region").alias("most"))
    buckets = buckets.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("mixed"))
    hits = _stored(found.join(buckets.hint("merge"), "anchor"))
    place = F.struct("ka", "kb", "start", "windows", "lead")
    regions = hits.where("mixed").groupBy("anchor", "region").agg(F.sum("times").cast("int").alias("times"), F.min(place).alias("at"))
    regions = cut_lineage(regions.select("anchor", "region", "times", "at.*"))
    members = regions.join(regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).hint("merge"), "anchor")

    # The bytes of one place of each region, read from the row that holds it.
    wanted = members.groupBy("ka", "kb").agg(F.collect_list(F.struct("anchor", "region", "times", "members", "start", "windows", "lead")).alias("wanted"))
    read = rows.join(wanted.hint("merge"), ["ka", "kb"]).select("ka", "kb", "text", F.explode("wanted").alias("w"))
    read = read.select("ka", "kb", "w.*", F.expr(f"substring(text, w.start + 1, w.windows + {length - 1})").alias("bytes"))
    read = _stored(read.dropDuplicates(["anchor", "region"]))
    few = read.where(F.col("members") <= BUCKET).repartition("anchor").sortWithinPartitions("anchor")
    spans = few.mapInArrow(_sorted_buckets(length), "ka long, kb int, lo long, hi long")
    many = read.where(F.col("members") > BUCKET)
    if not many.isEmpty():
        spans = spans.unionByName(_halved(many, length))

    # Everything else that was hit is repeated as a whole.
    single = regions.where("times = 1").select("anchor", "region")
    first = F.col("start").cast("long")
    enclosed = [F.col("ka"), F.col("kb"), first.alias("lo"), (first + F.col("times") * F.col("windows") - 1 + length).alias("hi")]
    whole = hits.where("not mixed").select(*enclosed)
    whole = whole.unionByName(hits.where("mixed").join(single.hint("merge"), ["anchor", "region"], "left_anti").select(*enclosed))
    return whole.unionByName(spans).groupBy("ka", "kb").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _merged(spans: list[dict]) -> np.ndarray:
    """Sorted disjoint (lo, hi) rows that cover the same bytes; touching ranges are one."""
    if not spans:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.array(sorted((s["lo"], s["hi"]) for s in spans), dtype=np.int64)
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return np.stack([pairs[head, 0], reach[np.append(head[1:], len(pairs)) - 1]], axis=1)


def _cut(batches):
    for batch in batches:
        out: dict[str, list] = {"removed": [], "kept": []}
        for value, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            text = value.as_buffer() if value.is_valid else b""
            ranges = _merged(spans.as_py() or [])
            view, at, parts = memoryview(text), 0, []
            for lo, hi in ranges.tolist():
                parts.append(view[at:lo])
                at = hi
            parts.append(view[at:])
            out["removed"].append([{"lo": lo, "hi": hi} for lo, hi in ranges.tolist()])
            out["kept"].append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in batch.schema.names if n not in ("text", "spans")], pa.array(out["removed"], _SPANS), pa.array(out["kept"], pa.binary())], names=[*[n for n in batch.schema.names if n not in ("text", "spans")], "removed", "kept"])


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(row, removed, kept): every row as one value, the disjoint byte ranges removed from its text, and the bytes left.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in
    the same text or another, the input's texts as they are.  All occurrences go,
    also of equal rows, and matches never reach over the end of a text.  NULL text is
    empty; texts shorter than ``length`` stay whole; an empty table gives an empty
    table.  A text is read in pieces of ``PIECE`` bytes.  ``kept`` is binary, because a
    range may end inside a character.
    """
    spans = repeated_spans(docs, doc_id, text, length)
    keyed = docs.select(F.struct(*[F.col(f"`{n}`").alias(n) for n in docs.columns if n != text]).alias("row"), *row_keys(doc_id, text), F.col(text).cast("binary").alias("text"))
    joined = keyed.join(spans.hint("merge"), ["ka", "kb"], "left").select("row", "text", "spans")
    shape = T.StructType(joined.select("row").schema.fields + T.StructType.fromDDL("removed array<struct<lo:bigint,hi:bigint>>, kept binary").fields)
    return joined.mapInArrow(_cut, shape)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    cut = drop_repeats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", length)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"])
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
