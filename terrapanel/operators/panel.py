"""Cell-day aggregation, densification and panel assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [n for n, t in df.dtypes if n not in leave_out and t.startswith(kinds)]


def cell_day_mean(df: DataFrame, keys: Sequence[str] = ("grid_id", "date"), columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column per key; rows with a NULL key are left out."""
    columns = list(columns) if columns is not None else numeric_columns(df, keys)
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def cell_day_count(df: DataFrame, keys: Sequence[str] = ("grid_id", "date"), out: str = "fire_count", extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows per key, plus further aggregates computed in the same pass."""
    more = [agg.alias(name) for name, agg in (extra or {}).items()]
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(out), *more)


def calendar(first: Column, last: Column) -> Column:
    """Array of all days from first to last."""
    return F.sequence(first, last, F.expr("interval 1 day"))


def densify(cells: DataFrame, first, last, *, date: str = "date", cell: str = "grid_id") -> DataFrame:
    """Every cell on every day of a calendar; the days are generated inside each row."""
    low, high = (c if isinstance(c, Column) else F.lit(c).cast("date") for c in (first, last))
    return cells.select(cell, F.explode(calendar(low, high)).alias(date))


def densify_observed(cells: DataFrame, facts: DataFrame, *, date: str = "date", cell: str = "grid_id") -> DataFrame:
    """Every cell on every day seen in ``facts``.

    The day list is one row of at most calendar length, inlined as a scalar.
    """
    days = facts.select(F.sort_array(F.collect_set(date)).alias("d")).scalar()
    return cells.select(cell, F.explode(days).alias(date))


def merge_factors(long: DataFrame, keys: Sequence[str], factor: str, value: str, names: Sequence[str], how: str = "inner") -> DataFrame:
    """One column per factor from long rows: the inner or outer merge of the factor tables on ``keys``.

    A single aggregate replaces the chain of joins: ``inner`` keeps keys that have a row
    of every factor, ``outer`` all keys.  Keys must be unique per factor.
    """
    wide = long.groupBy(*keys).agg(
        *[F.max(F.when(F.col(factor) == n, F.col(value))).alias(n) for n in names],
        reduce(lambda a, b: a + b, [(F.count_if(F.col(factor) == n) > 0).cast("int") for n in names]).alias("_factors"),
    )
    least = len(names) if how == "inner" else 1
    return wide.where(F.col("_factors") >= least).drop("_factors")


def join_factors(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The same merge for factor tables with their own columns; equal keys keep the exchanges aligned."""
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def build_panel(
    scaffold: DataFrame, facts: Sequence[DataFrame], *, zero_fill: Sequence[str] = (), keys: Sequence[str] = ("grid_id", "date")
) -> DataFrame:
    """Left-merge daily facts (unique per key) onto a dense scaffold in one exchange.

    Scaffold and facts are stacked and grouped once; keys outside the scaffold vanish,
    exactly as a left join would have it.
    """
    columns = [c for f in facts for c in f.columns if c not in keys]
    stacked = scaffold.select(*keys, F.lit(True).alias("_panel"))
    for fact in facts:
        stacked = stacked.unionByName(fact, allowMissingColumns=True)
    merged = stacked.groupBy(*keys).agg(F.max("_panel").alias("_panel"), *[F.max(c).alias(c) for c in columns])
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) if c in zero_fill else F.col(c) for c in columns]
    return merged.where("_panel").select(*keys, *filled)


def with_static(panel: DataFrame, dimension: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Left join of a per-cell dimension; Spark broadcasts it when its measured size allows."""
    return panel.join(dimension, cell, "left")


def keep_covered(panel: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the cells where each given column is known at least once.

    Takes a panel, one row per (cell, day): the test runs in the same exchange as the
    windows that follow, and a cell is never longer than the calendar.
    """
    tests = reduce(lambda a, b: a & b, [F.count(c).over(Window.partitionBy(key)) > 0 for c in columns])
    return panel.withColumn("_covered", tests).where("_covered").drop("_covered")


def build_labels(events: DataFrame, cells: DataFrame, first, last, *, cell: str = "grid_id", date: str = "date", label: str = "fire_today") -> DataFrame:
    """Dense 0/1 labels: 1 where at least one event fell into the cell that day."""
    positives = events.groupBy(date, cell).agg(F.lit(1).alias(label))
    return build_panel(densify(cells, first, last, date=date, cell=cell), [positives], zero_fill=[label], keys=(date, cell))


def build_examples(incidents: DataFrame, detections: DataFrame, cells: DataFrame, first, last) -> DataFrame:
    """Labels with same-day incident and detection summaries, for checking only: they leak the target.

    ``incidents``: (date, grid_id) rows; ``detections``: (date, grid_id, conf) rows;
    ``cells``: grid_id with its centroid columns.
    """
    keys = ("date", "grid_id")
    burned = cell_day_count(incidents, keys, "irwin_incidents").withColumn("fire_today", (F.col("irwin_incidents") > 0).cast("int"))
    seen = cell_day_count(detections, keys, "firms_detections", {"firms_conf_max": F.max("conf")})
    counts = ["fire_today", "irwin_incidents", "firms_detections", "firms_conf_max"]
    panel = build_panel(densify(cells, first, last), [burned, seen], zero_fill=counts, keys=keys)
    return with_static(panel, cells).select(*keys, *counts, *[c for c in cells.columns if c != "grid_id"])


def feature_columns(df: DataFrame, base: Sequence[str], *, optional: Sequence[str] = (), prefixes: Sequence[str] = (), drop: Sequence[str] = ()) -> list[str]:
    """``base`` plus the optional columns that exist plus every column with one of the prefixes, less ``drop``."""
    found = [c for c in optional if c in df.columns] + [c for c in df.columns if c.startswith(tuple(prefixes))]
    return [c for c in dict.fromkeys([*base, *found]) if c not in drop]


def align_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features with their labels, matched by key (rows have no position)."""
    return features.join(labels, list(keys), "inner")


def daily_totals(examples: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Column totals per day, missing values counting 0."""
    return examples.groupBy(date).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
