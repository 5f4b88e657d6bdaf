"""Conversation prefix trie by Spark SQL ROLLUP over positional turn columns.

A conversation is a row of turn ids, ``BLOCK`` columns wide; a longer one goes on in
further rows, each keyed by the node that the row before ended in.  One ``GROUP BY
..., ROLLUP (t1, ..., t8)`` then aggregates all prefixes of all lengths together, and
``grouping_id`` says how many columns a prefix takes.

The key of a node is the XOR of its turns' hashed (depth, turn id), 128 bits: it can
be carried along a conversation of any length by running totals, so that all blocks
are grouped in one pass and not one after the other.

Whole subtrees are sums over members.  A conversation *owns* the nodes of which it
is the smallest member; they are the end of its path, from some depth on.  So the
distinct nodes below a node are what its members own, a leaf belongs to the one
member that owns it, and two roll-ups give everything: the first who owns what, the
second the sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import send_if_small
from terrapanel.session import cut_lineage, shuffle_width

BLOCK = 8
# Blocks of one conversation that are totalled in one task, and bytes of ids hashed at a time.
RUN, CHUNK = 1024, 1 << 16
_TURNS = [f"t{j}" for j in range(1, BLOCK + 1)]


def numbered(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, id, bytes): the turns of each conversation, numbered from 1 by ``turn``, NULL first.

    NULL role or text is empty; turns of equal number follow each other by the hash
    of their content; rows without a conversation id belong to none and are left out.
    The rows are sorted by ranges, so that one conversation of any length is numbered
    by many tasks; what a range must add is a table of one row a range at most.
    """
    said, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    content = F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, text)))
    rows = convs.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), content.alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    ranged = rows.repartitionByRange(shuffle_width(convs.sparkSession), F.col("conv"), *order).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select("conv", "part", before.alias("before")).where("before > 0")
    inside = ranged.withColumn("place", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    place = F.col("place") + F.coalesce("before", F.lit(0))
    return inside.join(F.broadcast(carried), ["conv", "part"], "left").select("conv", place.cast("long").alias("place"), "id", "bytes")


def forked(turns: DataFrame, stem: Column, head: Column, longest_head: int) -> DataFrame:
    """Conversations that begin with the first ``head`` turns of conversation ``stem`` in place of their own.

    ``stem`` and ``head`` (at most ``longest_head``) are expressions of ``conv``.  A
    stem of fewer turns gives all it has, an absent one none; turns beyond the own
    first ``head`` follow.  Returns (conv, place, id, bytes); a conversation that is
    left without turns has one row with NULL place.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes.select("conv", "n", stem.alias("stem"), head.cast("long").alias("head")))
    stems = sizes.select(F.col("conv").alias("stem"), F.col("n").alias("has"))
    plan = sizes.join(stems, "stem", "left").withColumn("taken", F.least("head", F.coalesce("has", F.lit(0))))
    plan = cut_lineage(plan.select("conv", "stem", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")))
    small = send_if_small(plan, F.lit(64))
    own = turns.join(small, "conv").where("place > head").select("conv", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "id", "bytes")
    first = turns.where(F.col("place") <= longest_head).select(F.col("conv").alias("stem"), "place", "id", "bytes")
    copied = first.join(small, "stem").where("place <= head").select("conv", "place", "id", "bytes")
    bare = plan.where("length = 0").select("conv", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(copied).unionByName(bare)


def _mark(depth: Column, turn: Column, seed: int) -> Column:
    """What a turn adds to the key of the nodes at and below it."""
    return F.when(turn.isNotNull(), F.xxhash64(F.lit(seed), depth, turn)).otherwise(F.lit(0).cast("long"))


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = out.bitwiseXOR(column)
    return out


def _blocks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``BLOCK`` turns, (conv, block, p1, p2, before, t1..t8); and (conv, length, total, e1, e2) of each conversation.

    p1 and p2 are the key of the node the block starts from, ``before`` the bytes up to there.
    """
    at = F.col("place") - 1
    cells = turns.select("conv", F.coalesce(F.floor(at / BLOCK), F.lit(0)).cast("long").alias("block"), F.when(F.col("place").isNotNull(), F.struct(F.pmod(at, F.lit(BLOCK)).alias("slot"), "id", "bytes")).alias("cell"))
    rows = cells.groupBy("conv", "block").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    rows = rows.select("conv", "block", F.floor(F.col("block") / RUN).alias("run"), *[F.get("cells", F.lit(j)).dropFields("slot").alias(t) for j, t in enumerate(_TURNS)])
    depth = [F.col("block") * BLOCK + j for j in range(1, BLOCK + 1)]
    for seed in (1, 2):
        rows = rows.withColumn(f"x{seed}", _total([_mark(d, F.col(t)["id"], seed) for d, t in zip(depth, _TURNS, strict=True)]))
    size = sum((F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in _TURNS), F.lit(0))
    length = sum((F.coalesce(F.col(t)["bytes"], F.lit(0)) for t in _TURNS), F.lit(0))
    rows = cut_lineage(rows.withColumns({"size": size.cast("long"), "long": length.cast("long")}))
    ends = rows.groupBy("conv").agg(F.sum("size").alias("length"), F.sum("long").alias("total"), F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"))
    # Running totals inside runs of blocks; only conversations of more than one run take something over.
    zero = F.lit(0).cast("long")
    sums = {"p1": F.bit_xor("x1"), "p2": F.bit_xor("x2"), "before": F.sum("long")}
    earlier = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({n: F.coalesce(s.over(earlier), zero) for n, s in sums.items()})
    runs = rows.groupBy("conv", "run").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("long").alias("long"))
    passed = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("conv", "run", *[s.over(passed).alias(f"c_{n}") for n, s in sums.items()]).where("run > 0")
    joined = inside.join(send_if_small(carried, F.lit(40)), ["conv", "run"], "left")
    whole = [F.col("p1").bitwiseXOR(F.coalesce("c_p1", zero)).alias("p1"), F.col("p2").bitwiseXOR(F.coalesce("c_p2", zero)).alias("p2"), (F.col("before") + F.coalesce("c_before", zero)).alias("before")]
    return joined.select("conv", "block", *whole, *_TURNS), ends


def _roll_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """One row per node: its depth, bytes of the turns above its last one, its key and its parent's, and the aggregates."""
    columns = ", ".join(_TURNS)
    grouped = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, before, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, p1, p2, before, ROLLUP ({columns})",
        blocks=blocks,
    )
    # A prefix ends at a turn, and where a block starts, the block before has the node.
    held = sum((F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in _TURNS), F.lit(0))
    nodes = grouped.where((held == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    marks = {s: [_mark(F.col("block") * BLOCK + j, F.col(t)["id"], s) for j, t in enumerate(_TURNS, 1)] for s in (1, 2)}
    above = [F.when(F.col("level") > j, F.lit(True)) for j in range(1, BLOCK + 1)]
    keys = []
    for s in (1, 2):
        keys.append(_total([F.col(f"p{s}"), *marks[s]]).alias(f"k{s}"))
        keys.append(_total([F.col(f"p{s}"), *[F.when(a, m).otherwise(F.lit(0).cast("long")) for a, m in zip(above, marks[s], strict=True)]]).alias(f"q{s}"))
    start = F.col("before") + sum((F.when(a, F.col(t)["bytes"]).otherwise(0) for a, t in zip(above, _TURNS, strict=True)), F.lit(0))
    own = [n for n in grouped.columns if n not in ("block", "p1", "p2", "before", "level", *_TURNS)]
    return nodes.select((F.col("block") * BLOCK + F.col("level")).alias("depth"), start.alias("above"), *keys, *own)


def prefix_trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of all conversations, as (nodes, ends).

    ``turns`` is (conv, place, id, bytes) with places from 1 without gaps; a row with
    NULL place stands for a conversation without turns.  ``nodes`` has one row per
    distinct sequence of first turns, the empty one (depth 0) included: (conv, depth)
    name it by its smallest member; parent_conv, n_convs, n_children, n_leaves and
    saved (bytes of the turns below and in it that need not be repeated).  ``ends``
    has (conv, node_conv, depth): the node at which each conversation ends.  An empty
    table gives no nodes.
    """
    blocks, ends = _blocks(turns)
    blocks, ends = cut_lineage(blocks), cut_lineage(ends)
    lengths = send_if_small(ends.select("conv", "length"), F.lit(32))
    nodes = cut_lineage(_roll_up(blocks.join(lengths, "conv"), "min(conv) AS conv, max(length) AS longest"))

    # What each conversation owns: from which node on, and whether its end is a leaf.
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("first"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    firsts = nodes.join(owners.withColumnRenamed("first", "depth"), ["conv", "depth"])
    firsts = firsts.select("conv", F.col("depth").alias("first"), "leaf", "above", "q1", "q2")
    people = ends.join(firsts, "conv", "left").withColumn("own", F.coalesce(F.col("total") - F.col("above"), F.lit(0)))
    people = cut_lineage(people.withColumn("leaf", F.coalesce("leaf", F.lit(0))))

    # Two questions about a node of which only the key is known: who owns the parent of a conversation's
    # first own node, and who owns the end of a conversation that owns nothing.
    parents = people.where("first > 0").select("conv", (F.col("first") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.lit(True).alias("parent"))
    others = people.where("first is null").select("conv", F.col("length").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.lit(False).alias("parent"))
    known = nodes.select(F.col("conv").alias("node_conv"), "depth", "k1", "k2")
    answers = cut_lineage(parents.unionByName(others).join(known, ["depth", "k1", "k2"]).select("conv", "node_conv", "depth", "parent"))
    ended = people.where("first is not null").select("conv", F.col("conv").alias("node_conv"), F.col("length").alias("depth"))
    ended = ended.unionByName(answers.where("not parent").select("conv", "node_conv", "depth"))

    shares = send_if_small(people.select("conv", "total", "own", "leaf"), F.lit(48))
    sums = "min(conv) AS conv, count(*) AS n_convs, sum(total) AS total, sum(own) AS own, sum(leaf) AS n_leaves"
    summed = _roll_up(blocks.join(shares, "conv"), sums).drop("k1", "k2", "q1", "q2")
    of_owner = people.where("first is not null").select("conv", "first", "length", F.col("total").alias("owner_total"), F.col("own").alias("owner_own"))
    attached = answers.where("parent").select("conv", F.col("node_conv").alias("parent_conv"))
    of_owner = of_owner.join(attached, "conv", "left")
    branches = answers.where("parent").groupBy(F.col("node_conv").alias("conv"), "depth").agg(F.count(F.lit(1)).alias("branches"))
    full = summed.join(send_if_small(cut_lineage(of_owner), F.lit(64)), "conv").join(send_if_small(cut_lineage(branches), F.lit(40)), ["conv", "depth"], "left")
    # The turns at and below the node, of all members, less those that distinct nodes hold.
    said = F.col("total") - F.col("n_convs") * F.col("above")
    distinct = F.col("own") - F.col("owner_own") + F.col("owner_total") - F.col("above")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent_conv"))
    children = F.coalesce("branches", F.lit(0)) + (F.col("length") > F.col("depth")).cast("long")
    return full.select(
        "conv", "depth", parent.alias("parent_conv"), "n_convs", children.alias("n_children"), "n_leaves", (said - distinct).alias("saved")
    ), ended


def _joined_ids(batches):
    """Rows sorted by node and conv into (node_conv, depth, conv, ids): comma-joined ids, ``CHUNK`` bytes at most a row."""
    held, key, first, size = [], None, None, 0

    def row():
        return pa.RecordBatch.from_pydict({"node_conv": [key[0]], "depth": [key[1]], "conv": [first], "ids": [",".join(held)]}, schema=_IDS)

    for batch in batches:
        for node, depth, conv in zip(*(batch.column(n).to_pylist() for n in ("node_conv", "depth", "conv")), strict=True):
            if held and (key != (node, depth) or size > CHUNK):
                yield row()
                held, size = [], 0
            if not held:
                key, first = (node, depth), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _hashed_ids(batches):
    """Chunks sorted by node and first id into (node_conv, depth, sha256), read one after the other."""
    key, digest = None, None
    done: dict[str, list] = {"node_conv": [], "depth": [], "sha256": []}

    def put():
        for name, value in zip(done, (*key, digest.hexdigest()), strict=True):
            done[name].append(value)

    for batch in batches:
        for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node_conv", "depth", "ids")), strict=True):
            if key == (node, depth):
                digest.update(b",")
            else:
                if key is not None:
                    put()
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        if len(done["depth"]) > 10_000:
            yield pa.RecordBatch.from_pydict(done, schema=_DIGESTS)
            done = {n: [] for n in done}
    if key is not None:
        put()
    yield pa.RecordBatch.from_pydict(done, schema=_DIGESTS)


_IDS = pa.schema([("node_conv", pa.int64()), ("depth", pa.int64()), ("conv", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("node_conv", pa.int64()), ("depth", pa.int64()), ("sha256", pa.string())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_conv, depth, sha256): hash of the comma-joined ids, ascending, of the conversations that end at a node.

    The ids of one node are joined by as many tasks as ranges hold them; the last step streams the joined
    pieces through the hash, which is sequential by its nature, and holds one piece at a time.
    """
    width = shuffle_width(ends.sparkSession)
    keys = ["node_conv", "depth", "conv"]
    joined = ends.select(*keys).repartitionByRange(width, *keys).sortWithinPartitions(*keys).mapInArrow(_joined_ids, "node_conv long, depth long, conv long, ids string")
    return joined.repartition(width, "node_conv", "depth").sortWithinPartitions(*keys).mapInArrow(_hashed_ids, "node_conv long, depth long, sha256 string")


def report(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations, each begun anew from the first of its five.

    NULL conversation ids are left out, an empty table gives no rows, repeated rows
    are turns like others, and a conversation may have any number of turns.
    """
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    turns = forked(cut_lineage(numbered(convs, conv_id, turn, role, text)), conv - conv % 5, head, 8)
    nodes, ends = prefix_trie(turns)
    digests = send_if_small(cut_lineage(end_digests(cut_lineage(ends))), F.lit(96))
    nodes = nodes.join(digests.withColumnRenamed("node_conv", "conv"), ["conv", "depth"], "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
