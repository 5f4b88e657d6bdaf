"""Words, hashes, checked joins and connected components shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.session import cut_lineage

# The separators between words after A-Z became a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes a side may hold, counted before, to be sent to every executor.
BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` where the text is plain ASCII, because it is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; NULL for NULL."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def word_keys(text: Column) -> Column:
    """64-bit hashes of the words in order; no entries for NULL."""
    return F.transform(F.coalesce(words(text), F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def send_if_small(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size fits ``limit``; otherwise the join shuffles.

    ``size`` is the bytes of one row.  ``df`` should be a table that is cheap to
    read twice.
    """
    total = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an undirected edge table.

    Each round every node follows the neighbour (or itself) of least hashed
    priority and the edges are rewritten between those; the number of nodes falls
    by a constant factor a round whatever the shape of the graph, so that chains
    and stars end after a few rounds.  Only counts reach the driver.
    """
    def priority(node: str) -> Column:
        return F.struct(F.xxhash64(F.lit(17), F.col(node)).alias("p"), F.col(node).alias("n"))

    live = cut_lineage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    roots = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while live.limit(1).count():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        step = both.groupBy("u").agg(F.min(priority("v")).alias("least")).select("u", F.least(F.col("least"), priority("u"))["n"].alias("to"))
        step = cut_lineage(step)
        roots = roots.join(step, roots["root"] == step["u"], "left").select("node", F.coalesce("to", "root").alias("root"))
        left, right = step.toDF("a", "x"), step.toDF("b", "y")
        moved = live.join(left, "a").join(right, "b")
        live = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    roots = cut_lineage(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


# Helpers for code inside tasks.


def handed_back(rows):
    """``rows``, and then the memory that making them took: Python workers live on from stage to stage."""
    yield from rows
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
            ctypes.CDLL(None).malloc_trim(0)


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without NULL entries; NULL lists count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from scrambled 64-bit integers."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def chunks(offsets: np.ndarray, limit: int = 500_000):
    """Runs (lo, hi) of rows that hold ``limit`` values together, or one row that alone holds more."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups from the batches of a partition that is sorted by ``keys``."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        changed = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        last = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        carry = table.slice(last)
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which groups of a sorted table begin, and its length."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the least node each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
