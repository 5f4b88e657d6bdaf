"""Global order without a global window: prefix sums, exact quantiles, exact hash samples.

Each operator first shrinks its input with a map-side combined ``groupBy``, cuts the
value range into buckets that single tasks can hold, and carries totals between
buckets in a table with one row per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import cut_lineage, shuffle_width


def _bucket_side(df: DataFrame) -> int:
    """Side m of the m x m bucket split: about four buckets per shuffle partition."""
    return max(4, math.ceil(math.sqrt(4 * shuffle_width(df.sparkSession))))


def with_range_bucket(df: DataFrame, group: Sequence[str], order: str, *, side: int | None = None) -> DataFrame:
    """Adds ``_bucket``: ranges of ``order`` (per group) holding about equally many rows.

    Bucket bounds are quantile sketches, one array per group; a row finds its bucket
    in two short searches.  The sketch only balances work, results do not depend on it.
    The number of groups must be small (columns, classes).
    """
    m = side or _bucket_side(df)
    shares = ", ".join(f"{i / (m * m)!r}D" for i in range(1, m * m))
    cuts = df.groupBy(*group).agg(F.expr(f"percentile_approx(`{order}`, array({shares}), {max(1000, 4 * m * m)})").alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.expr(f"transform(sequence(1, {m - 1}), i -> _cuts[i * {m} - 1])"))
    if group:
        cuts = cuts.withColumnsRenamed({g: f"_g_{g}" for g in group})
        same = _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
        joined = df.join(F.broadcast(cuts), same).drop(*[f"_g_{g}" for g in group])
    else:
        bounds = cuts.select(F.struct("_cuts", "_coarse")).scalar()
        joined = df.withColumns({"_cuts": bounds["_cuts"], "_coarse": bounds["_coarse"]})
    joined = joined.withColumn("_hi", F.size(F.filter("_coarse", lambda c: c < F.col(order))))
    fine = F.slice("_cuts", F.col("_hi") * m + 1, F.lit(m))
    below = F.size(F.filter(fine, lambda c: c < F.col(order)))
    return joined.withColumn("_bucket", F.col("_hi") * m + F.least(below, F.lit(m - 1))).drop("_cuts", "_coarse", "_hi")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], *, group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Running totals ``out = sum(col)`` along ``order`` (unique per group), the row itself included.

    Integer columns give exact results in any partitioning.  The input is read three
    times: pass a table that is cheap to read, such as a materialised aggregate.
    """
    group = list(group)
    bucketed = with_range_bucket(df, group, order)
    totals = bucketed.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    step = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    over_buckets = Window.partitionBy(*(group or [F.lit(0)])).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{o}").over(over_buckets), F.lit(0)).alias(f"_t_{o}") for o in sums],
    )
    line = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*group, "_bucket").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    running = bucketed.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()})
    match = _all([F.col("_bucket") == F.col("_b"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]])
    joined = running.join(F.broadcast(carried), match)
    return joined.select(*df.columns, *[(F.col(o) + F.col(f"_t_{o}")).alias(o) for o in sums])


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value) rows of the given numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(name, share, value): exact quantiles with linear interpolation, NULLs left out.

    Works on distinct values with counts, so repeated values cost one row and no
    reducer ever holds a column.
    """
    counted = cut_lineage(long_values(df, columns).where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count("*").alias("n")))
    totals = counted.groupBy("name").agg(F.sum("n").alias("_total"))
    ranked = prefix_sums(counted, "value", {"upto": "n"}, group=["name"]).join(F.broadcast(totals), "name")
    start = F.col("upto") - F.col("n")

    def covers(rank: Column) -> Column:
        return (start <= rank) & (rank < F.col("upto"))

    def place(share: Column) -> Column:
        return (F.col("_total") - 1) * share

    # A value only goes on for the shares whose ranks it holds.
    wanted = F.filter(F.array(*[F.lit(float(s)) for s in shares]), lambda s: covers(F.floor(place(s))) | covers(F.ceil(place(s))))
    at = ranked.withColumn("share", F.explode(wanted)).withColumn("_h", place(F.col("share")))
    low, high = F.floor("_h"), F.ceil("_h")

    at = at.withColumns({"_lo": F.when(covers(low), F.col("value")), "_hi": F.when(covers(high), F.col("value"))})
    at = at.where(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
    found = at.groupBy("name", "share").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_h").alias("_h"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return found.select("name", "share", value.alias("value"))


def hash_text(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def take_by_hash(df: DataFrame, key: str, group: str, quota: Callable[[DataFrame], DataFrame], seed: int) -> DataFrame:
    """Adds ``_taken``: true for the ``_quota`` rows of each class with the smallest md5(key|seed).

    ``quota`` turns class sizes (group, _n) into (group, _quota).  Counting hash slots finds
    the slot each cut falls into; only that slot's rows are ranked, and the cut itself, one
    (hash, key) per class, then decides every row where it is.  The rows are never shuffled.
    """
    digest = hash_text(F.col(key), seed)
    hashed = df.select(group, F.col(key).alias("_key"), digest.alias("_hash"), F.substring(digest, 1, 4).alias("_slot"))
    slots = cut_lineage(hashed.groupBy(group, "_slot").agg(F.count("*").alias("_n")))  # at most 65,536 per class
    wanted = quota(slots.groupBy(group).agg(F.sum("_n").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = slots.withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(wanted), group)
    placed = placed.withColumn("_left", F.col("_quota") - F.col("_before"))
    cut_slots = placed.where("_left between 1 and _n").select(group, "_slot", "_left")  # at most one per class
    order = Window.partitionBy(group, "_slot").orderBy("_hash", "_key")
    ranked = hashed.join(F.broadcast(cut_slots), [group, "_slot"]).withColumn("_rank", F.row_number().over(order))
    last = ranked.where("_rank <= _left").groupBy(F.col(group).alias("_class")).agg(F.max(F.struct("_hash", "_key")).alias("_last"))
    joined = df.join(F.broadcast(last), F.col(group) == F.col("_class"), "left")
    taken = F.struct(digest.alias("_hash"), F.col(key).alias("_key")) <= F.col("_last")
    return joined.select(*df.columns, F.coalesce(taken, F.lit(False)).alias("_taken"))
