"""Near-duplicate documents by DartMinHash signatures, banding, and an exact check.

Elements are the shingles of five words of a document, with weights.  Each
element throws darts: a Poisson process over its region (weight x rank), the same
in every document.  A document keeps the darts below its weight and below a rank
chosen so that a fixed number is expected whatever its length, deals them to the
signature's coordinates by hash, and keeps the earliest of each coordinate.  The
work per document is its length plus the number of darts, and two documents agree
in a coordinate with the probability of their weighted Jaccard similarity.

From signatures to links:

* documents with equal words are one text from the start;
* texts that agree in a band of coordinates meet; where their signatures agree in
  ``FLOOR`` of all coordinates they become one family (a superset of the links);
* inside a family, pairs are compared exactly, likeliest first, unless already
  connected, so that a large family of copies costs few exact comparisons.

Groups too large for a task are cut into blocks and met block against block.
Pairs are never emitted; every step returns at most one edge per text and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import chunks, components, flat_lists, group_starts, handed_back, least_labels, mix, send_if_small, unit, whole_groups, word_keys
from terrapanel.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
# A pair of the wanted similarity agrees in fewer coordinates than this with a probability of about 1e-5.
FLOOR = 0.62
# Signatures a block holds, and shingles a block holds (on average).
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(values: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``size`` words, row by row; a row of fewer words, but not none, has one."""
    counts = np.diff(offsets)
    n = len(values)
    words = values.astype(np.uint64)
    length = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    rows = np.repeat(np.arange(len(counts)), length)
    first = offsets[:-1][rows] + (np.arange(out[-1]) - out[:-1][rows])
    span = np.minimum(counts, size)[rows]
    keys = np.zeros(len(first), dtype=np.uint64)
    for i in range(size):
        at = np.minimum(first + i, max(n - 1, 0))
        keys = np.where(i < span, mix(keys * np.uint64(31) + words[at] + np.uint64(i + 1)), keys)
    return keys, out


def weighted_sets(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row, sorted, with how often they occur, and the rows' offsets."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    return keys[at], times, np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=len(offsets) - 1))]).astype(np.int64)


def dart_signatures(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """(rows, size) of 16-bit dart names; rows without weight are all zero.

    ``keys`` are each row's distinct elements, ``weights`` their positive weights.
    An element's region is cut into layers of unit weight; in each, darts follow
    each other by rank with exponential steps, and the one of the top layer is
    dropped if its weight coordinate lies above the element's weight.
    """
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    layers = np.maximum(np.ceil(weights), 1).astype(np.int64)
    if len(layers) and layers.max() > 1:
        which = np.repeat(np.arange(len(keys)), layers)
        layer = np.arange(len(which)) - np.repeat(np.cumsum(layers) - layers, layers)
        rows, share = rows[which], np.minimum(weights[which] - layer, 1.0)
        region = mix(keys[which] + layer.astype(np.uint64) * _STEP)
    else:
        share, region = np.minimum(weights, 1.0).astype(np.float64), mix(keys)
    total = np.bincount(rows, weights=share, minlength=len(offsets) - 1)
    best = np.full((len(offsets) - 1) * size, np.inf)
    name = np.zeros((len(offsets) - 1) * size, dtype=np.uint16)
    expected = size * np.log(size) + 2 * size
    pending = total > 0
    while pending.any():
        limit = np.where(pending, expected / np.maximum(total, 1e-12), 0.0)
        live = np.flatnonzero(pending[rows])
        rank, thrown = np.zeros(len(live)), np.zeros(1, dtype=np.uint64)
        while len(live):
            thrown += _STEP
            dart = mix(region[live] + thrown)
            rank = rank - np.log(unit(dart))
            near = rank <= limit[rows[live]]
            live, rank, dart = live[near], rank[near], mix(dart[near])
            inside = unit(mix(dart + _STEP)) <= share[live]
            at = rows[live[inside]] * size + (dart[inside] >> np.uint64(32)).astype(np.int64) % size
            np.minimum.at(best, at, rank[inside])
            won = best[at] == rank[inside]
            name[at[won]] = (dart[inside][won] & np.uint64(0xFFFF)).astype(np.uint16)
        pending &= np.isinf(best.reshape(-1, size)).any(axis=1)
        expected *= 4
    return name.reshape(-1, size)


def _sign(batches, weighting: str):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values, offsets = flat_lists(table.column("words"))
        for lo, hi in chunks(offsets):
            keys, at = shingle_keys(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            keys, times, at = weighted_sets(keys, at)
            weights = times.astype(np.float64) if weighting == "count" else np.ones(len(keys))
            names = dart_signatures(keys, weights, at)
            flat = pa.array([row.tobytes() for row in names], type=pa.binary())
            part = table.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("id", "key", "node")), flat], names=["id", "key", "node", "sig"])


def _agreeing_pairs(sig: np.ndarray, starts: np.ndarray, side: np.ndarray, cross: np.ndarray, floor: float):
    """Pairs of rows of one group that agree in ``floor`` of all coordinates: (a, b, share), in pieces.

    Where ``cross`` is set for a group, only pairs from different sides count.
    """
    size = sig.shape[1]
    for g in range(len(starts) - 1):
        lo, hi = starts[g], starts[g + 1]
        if hi - lo < 2:
            continue
        left = np.arange(lo, hi)
        if cross[g]:
            left, right = left[side[lo:hi] == 0], left[side[lo:hi] == 1]
            if not len(left) or not len(right):
                continue
        else:
            right = left
        step = max(1, 4_000_000 // (len(right) * size))
        for i in range(0, len(left), step):
            mine = left[i : i + step]
            share = (sig[mine][:, None, :] == sig[right][None, :, :]).mean(axis=2, dtype=np.float32)
            hit = share >= floor
            if not cross[g]:
                hit &= mine[:, None] < right[None, :]
            x, y = np.nonzero(hit)
            if len(x):
                yield mine[x], right[y], share[x, y]


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(table.num_rows, -1)


def _families(batches, floor: float):
    for table in whole_groups(batches, ["key", "i", "j"]):
        starts = group_starts(table, ["key", "i", "j"])
        i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "block"))
        found = list(_agreeing_pairs(_signatures_of(table), starts, (block != i).astype(np.int8), (i != j)[starts[:-1]], floor))
        if found:
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            label = least_labels(table.num_rows, a, b)
            at = np.flatnonzero(label != np.arange(table.num_rows))
            node = table.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], names=["a", "b"])


def _links(batches, floor: float, similarity: float, weighting: str):
    for table in whole_groups(batches, ["family", "i", "j"]):
        starts = group_starts(table, ["family", "i", "j"])
        i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "block"))
        values, offsets = flat_lists(table.column("words"))
        node = table.column("node").to_numpy()
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def shingles(row: int):
            if row not in sets:
                keys, at = shingle_keys(values[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))
                keys, times, _ = weighted_sets(keys, at)
                sets[row] = keys, (times if weighting == "count" else np.ones(len(keys)))
            return sets[row]

        found = list(_agreeing_pairs(_signatures_of(table), starts, (block != i).astype(np.int8), (i != j)[starts[:-1]], floor))
        if not found:
            continue
        a, b, share = (np.concatenate([f[c] for f in found]) for c in range(3))
        up = np.arange(table.num_rows)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for pair in np.argsort(-share, kind="stable"):
            x, y = int(a[pair]), int(b[pair])
            rx, ry = root(x), root(y)
            if rx == ry:
                continue
            (kx, wx), (ky, wy) = shingles(x), shingles(y)
            tx, ty = wx.sum(), wy.sum()
            if min(tx, ty) < similarity * max(tx, ty):
                continue
            _, px, py = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
            common = np.minimum(wx[px], wy[py]).sum()
            if common >= similarity * (tx + ty - common) - 1e-9:
                up[max(rx, ry)] = min(rx, ry)
                out.append((node[x], node[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], type=pa.int64()), pa.array([y for _, y in out], type=pa.int64())], names=["a", "b"])


def _in_blocks(df: DataFrame, key: str, blocks: Column, columns: list[str]) -> DataFrame:
    """Every row once for each pair of blocks its own belongs to: columns plus block, i, j."""
    placed = df.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("_blocks")).cast("int"))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    return other.select(key, F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", *columns)


def _text_key(text: str) -> Column:
    """A hash of a text as it stands, cheaper to compute than its words."""
    return F.xxhash64(F.lit(4), F.col(text))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["key"] == right["key"]) & left["id"].eqNullSafe(right["id"])


def _linked_texts(docs: DataFrame, doc_id: str, text: str, similarity: float, weighting: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, links) of all rows given, those without an id too.

    Rows: id, key of the text, node (the text's words; NULL: none).  Texts: one row
    (node, id, key, n) for each node, the least id that has it (none last), its
    least key, and how many rows have both.  Links: (node, component).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("id"), _text_key(text).alias("key"), word_keys(F.col(text)).alias("words"))
    keyed = keyed.select("id", "key", F.when(F.size("words") > 0, F.xxhash64(F.lit(3), "words")).alias("node"), "words")
    signed = cut_lineage(keyed.mapInArrow(lambda it: handed_back(_sign(it, weighting)), f"id {kind}, key bigint, node bigint, sig binary"))
    members = signed.select("id", "key", "node")
    least = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("least"))
    least = least.select(F.col("node").alias("_node"), F.col("least.id").alias("id"), F.col("least.key").alias("key"))
    texts = signed.join(least, (signed["node"] == least["_node"]) & _same_row(signed, least)).select("node", signed["id"], signed["key"], "sig")
    texts = cut_lineage(texts.groupBy("node").agg(F.first("id").alias("id"), F.first("key").alias("key"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = texts.select("node", "sig", band.alias("band")).select("node", F.xxhash64("band", F.substring("sig", F.col("band") * 2 * ROWS + 1, F.lit(2 * ROWS))).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(bands.join(shared, "key"))
    met = met.join(texts.select("node", "sig"), "node")
    met = _in_blocks(met, "key", F.ceil(F.col("n") / BLOCK_TEXTS), ["node", "sig"])
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    family = components(met.mapInArrow(lambda it: handed_back(_families(it, FLOOR)), "a bigint, b bigint"))

    suspects = cut_lineage(family.withColumnRenamed("component", "family").join(texts, "node"))
    whole = docs.select(F.col(doc_id).alias("id"), _text_key(text).alias("key"), F.col(text).alias("_text"))
    full = whole.join(send_if_small(suspects, F.lit(250)), _same_row(whole, suspects)).select("family", "node", "sig", "_text")
    if suspects.where("n > 1").limit(1).count():
        full = full.dropDuplicates(["node"])
    full = cut_lineage(full.select("family", "node", "sig", word_keys(F.col("_text")).alias("words")))
    sizes = full.groupBy("family").agg(F.sum(F.size("words")).alias("total"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS))
    full = _in_blocks(full.join(sizes, "family"), "family", blocks, ["node", "sig", "words"])
    full = full.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    linked = components(full.mapInArrow(lambda it: handed_back(_links(it, FLOOR, similarity, weighting)), "a bigint, b bigint"))
    return members, texts.select("node", "id", "key", "n"), linked


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """(doc_id, class_id, kept): documents linked, directly or through others, by similar shingles.

    Two texts are linked where the Jaccard similarity of their shingles, as sets
    or weighted by ``count``, is ``similarity`` or more.  ``class_id`` is the least
    id of the class, ``kept`` says that the row has it.  Documents without words
    link with nothing; a row whose id is NULL stands alone, class NULL, kept.
    Repeated rows are one text and are all returned.  An empty table gives an
    empty table.
    """
    if weighting not in ("set", "count"):
        raise ValueError("weighting is set or count")
    kind = docs.schema[doc_id].dataType.simpleString()
    members, texts, linked = _linked_texts(docs.where(F.col(doc_id).isNotNull()), doc_id, text, similarity, weighting)
    # One row per linked text carries its class; the documents only look theirs up.
    found = linked.join(texts.select("node", "id"), "node")
    least = found.groupBy("component").agg(F.min("id").alias("class_id"))
    found = found.join(least, "component").select("node", "class_id")
    classes = cut_lineage(texts.select("node", "id").join(found, "node", "left").select("node", F.coalesce("class_id", "id").alias("class_id")))
    wordless = members.where(F.col("node").isNull()).select("id", F.col("id").alias("class_id"))
    out = members.select("id", "node").join(classes, "node").select("id", "class_id").unionByName(wordless)
    out = out.select(F.col("id").alias(doc_id), "class_id").withColumn("kept", F.col(doc_id) == F.col("class_id"))
    alone = docs.where(F.col(doc_id).isNull()).select(F.col(doc_id).alias(doc_id), F.lit(None).cast(kind).alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, unnamed: bool = False) -> DataFrame:
    """``docs``, all columns, with one document of each class: the text of the least id, then of the least key.

    Texts are judged, not ids: an id may stand for several, each in its own class.
    Of rows equal in id and text one stays.  Rows without an id all stay, or, if
    ``unnamed`` is set, belong to classes as all others do, after those with an id;
    then only those without words all stay.
    """
    rows = docs if unnamed else docs.where(F.col(doc_id).isNotNull())
    members, texts, linked = _linked_texts(rows, doc_id, text, similarity, "set")
    found = linked.join(texts, "node")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")).alias("least"))
    lost = found.join(least, "component").where(F.col("node") != F.col("least.node")).select("node", F.lit(True).alias("lost"))
    texts = cut_lineage(texts.join(lost, "node", "left").select("node", F.col("id").alias("_id"), F.col("key").alias("_key"), "n", F.col("lost").isNotNull().alias("lost")))
    first = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    dropped = cut_lineage(members.join(texts, "node").where(F.col("lost") | ~first).select("id", "key").distinct())
    dropped = send_if_small(dropped, F.lit(32))
    wordless = members.where(F.col("node").isNull() & F.col("id").isNotNull()).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    again = texts.where(~F.col("lost")).select(F.col("_id").alias("id"), F.col("_key").alias("key"), "n").unionByName(wordless)
    again = cut_lineage(again.where("n > 1").select("id", "key"))

    # The row travels as one value, so that its columns may have any names.
    placed = docs.select(F.struct(*[F.col(f"`{n}`").alias(n) for n in docs.columns]).alias("_row"), F.col(doc_id).alias("id"), _text_key(text).alias("key"))
    out = placed.join(dropped, _same_row(placed, dropped), "left_anti")
    if again.limit(1).count():
        again = send_if_small(again, F.lit(32))
        once = out.join(again, _same_row(out, again), "left_semi").dropDuplicates(["id", "key"])
        out = out.join(again, _same_row(out, again), "left_anti").unionByName(once)
    return out.select("_row.*")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return near_duplicates(docs, doc_id, text)
