"""Two-pass external shuffle into shards.

Pass one scatters the records over buckets sized to fit a task's memory, by
seeded hashes.  Pass two shuffles each bucket (Fisher-Yates, Spark's ``shuffle``)
and deals the concatenated buckets out to the shards in turn, so that the shards'
row counts differ by one at most and each shard is a uniform sample in random
order.  All built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import send_if_small
from terrapanel.session import cut_lineage

# Bytes of records a bucket is meant to hold, how many buckets a task takes one after
# the other, so that tasks are of even size, and the least number of tasks.
BUCKET_BYTES, BUCKETS_PER_TASK, LEAST_TASKS = 8 << 20, 4, 64


def _record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """Adds ``_copy``: rows of equal ``_content`` are numbered from 0, in any order.

    Only rows that have an equal are touched.  They are numbered where they were
    read and then carry on from what other parts of the table hold of them, so a
    group of any size is never in one task.
    """
    twice = rows.groupBy("_content").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_content")
    twice = send_if_small(cut_lineage(twice), F.lit(24))
    single = rows.join(twice, "_content", "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    copies = cut_lineage(rows.join(twice, "_content", "left_semi").withColumn("_part", F.spark_partition_id()))
    held = copies.groupBy("_content", "_part").agg(F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(held.select("_content", "_part", before.alias("_first")))
    here = F.row_number().over(Window.partitionBy("_content", "_part").orderBy("_size")) - 1
    numbered = copies.withColumn("_here", here).join(send_if_small(starts, F.lit(40)), ["_content", "_part"])
    return single.unionByName(numbered.withColumn("_copy", (F.col("_first") + F.col("_here")).cast("long")).select(*single.columns))


def shuffle_into_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``_shard`` (0 to shards-1) and ``_slot`` (0, 1, ... in each shard).

    Columns of those two names in the input are replaced.

    A record's bucket follows from the seed, its id, its text and its number among
    the rows equal in both, so equal rows spread over the buckets like others, and
    ids and texts are dealt alike however the table is split and Spark is set.
    NULL ids and texts are records like others; an empty table gives an empty table.
    """
    names = [n for n in docs.columns if n not in ("_shard", "_slot")]
    size = _record_bytes(F.col(text))
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    tasks = max(LEAST_TASKS, -(-total // (bucket_bytes * BUCKETS_PER_TASK)))
    buckets = tasks * BUCKETS_PER_TASK
    content = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    # The record travels as one value, so that its columns may have any names.
    rows = docs.select(content.alias("_content"), size.alias("_size"), F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("_value"))
    order = F.xxhash64("_content", "_copy")
    record = F.struct(order.alias("_order"), "_value.*").alias("_record")
    keyed = _copy_numbers(rows).select(F.pmod(order, F.lit(buckets)).cast("int").alias("_bucket"), "_size", record)
    sizes = cut_lineage(keyed.groupBy("_bucket").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")))

    # How many records the buckets before hold: prefix sums over blocks, so that no task sees all buckets.
    block = (F.col("_bucket") / 4096).cast("int")
    inner = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("_block", block).groupBy("_block").agg(F.sum("rows").alias("rows"))
    blocks = blocks.select("_block", F.coalesce(F.sum("rows").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = sizes.withColumn("_block", block).withColumn("_in", F.coalesce(F.sum("rows").over(inner), F.lit(0))).join(F.broadcast(blocks), "_block")
    starts = cut_lineage(starts.select("_bucket", (F.col("_before") + F.col("_in")).cast("long").alias("_start")))

    scattered = keyed.select("_bucket", "_record").repartition(tasks, "_bucket").sortWithinPartitions("_bucket")
    # Sorting first makes the outcome of the seeded shuffle independent of the order of arrival.
    held = scattered.groupBy("_bucket").agg(F.collect_list("_record").alias("_all"))
    ordered = F.array_sort("_all", lambda a, b: F.when(a["_order"] < b["_order"], F.lit(-1)).when(a["_order"] > b["_order"], F.lit(1)).otherwise(F.lit(0)))
    mixed = held.select("_bucket", F.shuffle(ordered, F.lit(seed)).alias("_all")).select("_bucket", F.posexplode("_all").alias("_at", "_record"))
    dealt = mixed.join(send_if_small(starts, F.lit(24)), "_bucket").withColumn("_place", F.col("_start") + F.col("_at"))
    return dealt.select(
        *[F.col(f"_record.c{i}").alias(n) for i, n in enumerate(names)],
        F.pmod("_place", F.lit(shards)).cast("int").alias("_shard"), F.floor(F.col("_place") / shards).cast("long").alias("_slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = 42, slots_per_file: int = 100_000) -> None:
    """Write the shuffled records as Parquet, ``_shard=0`` to ``_shard=N-1``, each file a run of slots in order.

    The shuffled table is stored before it is sorted into files, so that a task
    that is run again reads the same order.
    """
    dealt = cut_lineage(shuffle_into_shards(docs, shards, doc_id, text, seed))
    dealt = dealt.withColumn("_run", F.floor(F.col("_slot") / slots_per_file))
    ordered = dealt.repartition("_shard", "_run").sortWithinPartitions("_shard", "_run", "_slot").drop("_run")
    ordered.write.mode("overwrite").partitionBy("_shard").parquet(path)


def report(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every record; the law that holds is ``rows``."""
    kept = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text))
    dealt = shuffle_into_shards(kept, shards, doc_id, text, seed)
    return dealt.select(
        doc_id, _record_bytes(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
