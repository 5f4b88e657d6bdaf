"""Audits of label panels and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.cleaning import missing_columns
from terrapanel.operators.distributed import exact_quantiles, long_values
from terrapanel.operators.panel import densify


def null_fraction(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(name, missing, rows, fraction) of all columns in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"k_{c}") for c in columns])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col("rows") - F.col(f"k_{c}")).alias("missing")) for c in columns]))
    out = counts.select("rows", listed.alias("m"))
    return out.select("m.name", "m.missing", "rows", F.try_divide(F.col("m.missing").cast("double"), F.col("rows").cast("double")).alias("fraction"))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, rows, missing, missing_pct, mean, std, min, q25, q50, q75, max) per column; std is the sample one."""
    value = F.col("value")
    moments = long_values(df, columns).groupBy("name").agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count(value)).alias("missing"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    cuts = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    quartiles = cuts.groupBy("name").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    joined = moments.join(F.broadcast(quartiles), "name", "left")  # one row per column
    return joined.withColumn("missing_pct", F.col("missing") * 100.0 / F.col("rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with the NULL group kept."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def positive_rate(labels: DataFrame, by: Sequence[str] = ("date",), label: str = "fire_today") -> DataFrame:
    return labels.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("pos_rate"))


def bad_dates(labels: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    day = F.col(date).try_cast("date")
    return labels.where(~F.coalesce(day.between(first, last), F.lit(False)))


def bad_values(labels: DataFrame, label: str = "fire_today") -> DataFrame:
    return labels.where(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))


def unknown_cells(labels: DataFrame, cells: DataFrame, cell: str = "grid_id") -> DataFrame:
    return labels.join(cells.select(cell).distinct(), cell, "left_anti")


def positives_without_event(labels: DataFrame, events: DataFrame, keys: Sequence[str] = ("date", "grid_id"), label: str = "fire_today") -> DataFrame:
    positive = labels.where(F.col(label) == 1).select(*keys).distinct()
    return positive.join(events.select(*keys).distinct(), list(keys), "left_anti")


def missing_cell_days(labels: DataFrame, cells: DataFrame, first: str, last: str) -> DataFrame:
    """Pairs a complete panel would have and this one lacks."""
    return densify(cells.select("grid_id").distinct(), first, last).join(labels.select("grid_id", "date"), ["grid_id", "date"], "left_anti")


def completeness(labels: DataFrame, cells: DataFrame, first: str, last: str) -> DataFrame:
    """One row (cells, days, expected_rows, label_rows, complete)."""
    n_cells = cells.agg(F.count_distinct("grid_id")).scalar()
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")).cast("long") + 1
    out = labels.agg(F.count("*").alias("label_rows")).select(n_cells.alias("cells"), days.alias("days"), "label_rows")
    expected = F.col("cells") * F.col("days")
    return out.withColumns({"expected_rows": expected, "complete": F.col("label_rows") == expected})


def _metric(df: DataFrame, section: str, *metrics: tuple[str, Column]) -> DataFrame:
    """Aggregates of ``df`` as (section, metric, value) rows."""
    row = df.agg(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("string").alias("value")) for n, v in metrics]).alias("m"))
    return row.select(F.lit(section).alias("section"), F.explode("m").alias("m")).select("section", "m.*")


def source_overview(incidents: DataFrame) -> DataFrame:
    """Rows, date span, and counts by type and state as (section, metric, value)."""
    span = _metric(incidents, "incidents", ("rows", F.count("*")), ("date_min", F.min("date")), ("date_max", F.max("date")))
    for column in ("type", "state"):
        if column in incidents.columns:
            counts = value_counts(incidents, column)
            span = span.unionByName(
                counts.select(F.lit(f"{column}_counts").alias("section"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("metric"), F.col("n").cast("string").alias("value"))
            )
    return span


def qa_report(
    labels: DataFrame, cells: DataFrame, incidents: DataFrame, first: str, last: str, events: DataFrame | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(section, metric, value) rows and the violating rows by name."""
    violations = {"bad_dates": bad_dates(labels, first, last), "bad_values": bad_values(labels), "missing_grid_ids": unknown_cells(labels, cells)}
    if events is not None:
        violations["labels_not_in_events"] = positives_without_event(labels, events)
    shape = _metric(
        completeness(labels, cells, first, last),
        "shape",
        ("lookup_cells", F.max("cells")),
        ("label_rows", F.max("label_rows")),
        ("expected_rows", F.max("expected_rows")),
    )
    lacking = missing_columns(labels, ("date", "grid_id", "fire_today"))
    columns = _metric(labels.limit(1), "columns", ("missing", F.lit(",".join(lacking))))
    positive = F.sum((F.col("fire_today") == 1).cast("long"))
    rates = _metric(labels, "positives", ("positives", positive), ("pos_rate", positive / F.count("*")))
    report = shape.unionByName(columns).unionByName(rates).unionByName(source_overview(incidents))
    for name, rows in violations.items():
        report = report.unionByName(_metric(rows, "violations", (name, F.count("*"))))
    return report, violations
