"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosine.

Normalised vectors of cosine ``c`` lie ``sqrt(2 - 2c)`` apart, so one distance
bounds all wanted pairs.  Each of ``TABLES`` tables cuts ``PROJECTIONS`` Gaussian
projections into steps of ``STEP`` and buckets vectors of one label by the step
numbers.  Equal vectors of a label are one from the start and carry their number.
Buckets of one vector are dropped by counting before any vector moves.
Inside a bucket all cosines are computed in double precision, block against
block where it is large; a pair counts in the first table it meets in, so that
links are counted without emitting pairs, and connected by one edge per vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import components, flat_lists, group_starts, least_labels, mix, whole_groups
from terrapanel.session import cut_lineage

COSINE = 0.98
# At the bounding distance of 0.2 a pair meets in a table with probability 0.24, and misses all tables with 0.001.
TABLES, PROJECTIONS, STEP = 24, 10, 1.2
BLOCK = 1024
_STEP64 = np.uint64(0x9E3779B97F4A7C15)


def projections(dim: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The Gaussian directions (dim, tables * projections) and offsets of all tables, the same everywhere."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, STEP, TABLES * PROJECTIONS)


def bucket_keys(unit_vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(vectors, TABLES) bucket keys."""
    directions, offsets = projections(unit_vectors.shape[1])
    steps = np.floor((unit_vectors @ directions + offsets) / STEP).astype(np.int64).reshape(len(unit_vectors), TABLES, PROJECTIONS)
    keys = mix(labels.astype(np.int64).astype(np.uint64)[:, None] * _STEP64 + np.arange(1, TABLES + 1, dtype=np.uint64)[None, :])
    keys = mix(keys + np.uint64(unit_vectors.shape[1]))
    for p in range(PROJECTIONS):
        keys = mix(keys * np.uint64(31) + steps[:, :, p].astype(np.uint64))
    return keys.view(np.int64)


def _hash(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values, offsets = flat_lists(table.column("vector"))
        lengths = np.diff(offsets)
        labels = table.column("label").to_numpy()
        keys = np.zeros((table.num_rows, TABLES), dtype=np.int64)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            x = values[(offsets[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys[at] = bucket_keys(x, labels[at])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1) * TABLES, type=pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*[table.column(n).combine_chunks() for n in ("id", "copies", "vector")], lists], names=["id", "copies", "vector", "keys"])


def _link(batches, cosine: float):
    for table in whole_groups(batches, ["key", "i", "j"]):
        starts = group_starts(table, ["key", "i", "j"])
        ids, copies, i, j, block, at_table = (table.column(c).to_numpy() for c in ("id", "copies", "i", "j", "block", "at"))
        keys = flat_lists(table.column("keys"))[0].reshape(-1, TABLES)
        values, offsets = flat_lists(table.column("vector"))
        count = np.zeros(table.num_rows, dtype=np.int64)
        ends = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            rows = np.arange(lo, hi)
            dim = offsets[lo + 1] - offsets[lo]
            if hi - lo < 2 or (np.diff(offsets[lo : hi + 1]) != dim).any():
                continue
            x = values[offsets[lo] : offsets[hi]].astype(np.float64).reshape(hi - lo, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            near = x @ x.T >= cosine
            if i[lo] == j[lo]:
                near &= rows[:, None] < rows[None, :]
            else:
                own = block[lo:hi] == i[lo]
                near &= own[:, None] & ~own[None, :]
            a, b = np.nonzero(near)
            a, b = a + lo, b + lo
            # A pair belongs to the first table it meets in.
            new = np.ones(len(a), dtype=bool)
            for t in range(int(at_table[lo])):
                new &= keys[a, t] != keys[b, t]
            a, b = a[new], b[new]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            ends.append((a, b))
        if not ends or not count.any():
            continue
        a, b = (np.concatenate([e[c] for e in ends]) for c in range(2))
        label = least_labels(table.num_rows, a, b)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(count[at]), pa.array(ids[label[at]])], names=["id", "links", "to"])


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows of equal labels link at a cosine of ``cosine`` or more, which must be at
    least ``COSINE``, for which the tables are laid out.  Without label, without
    id, or with a vector that is NULL, empty, zero or holds NULL or a non-finite
    number, a row links with nothing (component NULL where the id is).  An id
    stands for one vector: repeated rows are returned as often, with equal values.
    """
    if cosine < COSINE:
        raise ValueError(f"the tables are laid out for cosines of {COSINE} and more")
    # Vectors travel as they are stored; tasks compute with them in double precision.
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"), F.col(label).cast("long").alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    usable = rows.where(F.coalesce(usable, F.lit(False)))

    # Which vector an id stands for follows from the rows' content alone; equal ones of a label are one, named by the least id.
    names = ["h1", "h2"]
    usable = usable.select("*", *[F.xxhash64(F.lit(k), F.col("label"), F.col("vector")).alias(n) for k, n in enumerate(names)])
    owned = cut_lineage(usable.groupBy("id").agg(F.min(F.struct(*names)).alias("h")).select("id", "h.*"))
    folded = cut_lineage(owned.groupBy(*names).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    content = usable.dropDuplicates(names).drop("id").join(folded, names).select(F.col("node").alias("id"), "copies", "vector", "label")
    kind = content.schema["vector"].dataType.simpleString()
    hashed = cut_lineage(content.mapInArrow(_hash, f"id bigint, copies bigint, vector {kind}, keys array<bigint>"))
    entries = hashed.select("id", F.posexplode("keys").alias("at", "key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(entries.join(shared, "key"))
    live = hashed.join(met.groupBy("id").agg(F.collect_list(F.struct("key", "at", "n")).alias("places")), "id")
    placed = live.select("id", "copies", "vector", "keys", F.explode("places").alias("p")).select("id", "copies", "vector", "keys", "p.key", "p.at", F.ceil(F.col("p.n") / BLOCK).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "at", "id", "copies", "keys", "vector")
    met_in = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = cut_lineage(met_in.mapInArrow(lambda it: _link(it, cosine), "id bigint, links bigint, to bigint"))

    counted = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    groups = components(links.where("id <> to"), "id", "to").select(F.col("node").alias("id"), "component")
    found = folded.withColumnRenamed("node", "id").join(counted, "id", "left").join(groups, "id", "left")
    # A vector's copies link with each other too.
    found = found.select(*names, (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    of_id = cut_lineage(owned.join(found, names).select("id", "n_links", "component"))
    out = rows.select("id").join(of_id, "id", "left")
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
