"""Per-series gap filling, rolling features and run lengths.

A series is one row per (key, order): feed panels that were aggregated to
(cell, day) first.  Its length is then the number of days, however many raw
observations one cell attracts, so a window partition is bounded by the calendar.

A series longer than a task can hold is named by ``block_rows``: its rows are numbered
across tasks, cut into blocks of that many, and each block is worked on by itself.  What
it needs from others is little: the last and next known row, from a table with one
row a block, and for rolling frames the few rows before it, which go to both blocks.
Results are the same with and without.

Backward looks run as forward looks over the reversed order: a frame that ends at
"unbounded following" is re-read for every row, one that starts at "unbounded
preceding" is read once.  All windows of one key share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.operators.distributed import with_range_bucket
from terrapanel.session import cut_lineage, shuffle_width

# Rows of one series in a task, for callers without a reason for another number.
SERIES_ROWS = 1 << 16

_AGGREGATES = {"mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _forward(key, order):
    return Window.partitionBy(*_cols(key)).orderBy(*_cols(order))


def _seen(key, order):
    return _forward(key, order).rowsBetween(Window.unboundedPreceding, 0)


def _ahead(key, order):
    reverse = Window.partitionBy(*_cols(key)).orderBy(*[F.col(c).desc() for c in _cols(order)])
    return reverse.rowsBetween(Window.unboundedPreceding, 0)


def position(order: str) -> Column:
    """Days since the epoch of a date (or timestamp) column."""
    return F.unix_date(F.col(order).cast("date"))


def _beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    renamed = small.withColumnsRenamed({k: f"_key{n}" for n, k in enumerate(keys)})
    same = F.col(keys[0]).eqNullSafe(F.col("_key0"))
    for n, k in enumerate(keys[1:], 1):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{n}"))
    return df.join(renamed, same, "left").drop(*[f"_key{n}" for n in range(len(keys))])


def numbered(df: DataFrame, key, order: str) -> DataFrame:
    """Adds ``_n``: each row's number in its series, from 1, found range by range of ``order``, materialised."""
    keys = _cols(key)
    ranged = cut_lineage(with_range_bucket(df, [], order))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"))
    inside = ranged.withColumn("_n", F.row_number().over(_forward([*keys, "_bucket"], order)))
    joined = _beside(inside, before, [*keys, "_bucket"])
    return cut_lineage(joined.select(*df.columns, (F.col("_n") + F.col("_before")).cast("long").alias("_n")))


def _blocks(df: DataFrame, key, order: str, reach: int, block_rows: int) -> tuple[DataFrame, list[str]]:
    """Rows with their block ``_b``, and as guests (``_guest``) in the next one if less than ``reach`` rows from it; and the blocks' keys."""
    if reach > block_rows:
        raise ValueError("a block must hold the rows a frame reaches back")
    at = F.col("_n") - 1
    own = F.floor(at / block_rows).cast("long")
    places = F.when(at % block_rows >= block_rows - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = numbered(df, key, order).withColumn("_b", F.explode(places))
    return rows.withColumn("_guest", F.col("_b") != own), [*_cols(key), "_b"]


def _own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_guest")).drop("_n", "_b", "_guest")


def neighbours(df: DataFrame, key, order: str, col: str, at: Column, block_rows: int | None = None) -> DataFrame:
    """Adds row number ``_n``, place ``_a`` and the nearest known rows before (``_p``) and after (``_f``)."""
    known = F.col(col).isNotNull()
    if block_rows is None:
        df = df.withColumn("_n", F.row_number().over(_forward(key, order))).withColumn("_a", at)
        point = F.when(known, F.struct(F.col(col).alias("v"), F.col("_n").alias("n"), F.col("_a").alias("a")))
        df = df.withColumn("_p", F.last(point, ignorenulls=True).over(_seen(key, order)))
        return df.withColumn("_f", F.last(point, ignorenulls=True).over(_ahead(key, order)))
    keys = _cols(key)
    df = numbered(df, key, order).withColumns({"_a": at, "_b": F.floor((F.col("_n") - 1) / block_rows)})
    point = F.when(known, F.struct(F.col("_n").alias("n"), F.col(col).alias("v"), F.col("_a").alias("a")))
    # One row a block: its first and last known rows, and those of the blocks before and after.
    ends = df.groupBy(*keys, "_b").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, "_b", earlier.alias("_earlier"), later.alias("_later"))
    block = [*keys, "_b"]
    df = df.withColumn("_p", F.last(point, ignorenulls=True).over(_seen(block, "_n"))).withColumn("_f", F.last(point, ignorenulls=True).over(_ahead(block, "_n")))
    joined = _beside(df, carried, block)
    return joined.withColumns({"_p": F.coalesce("_p", "_earlier"), "_f": F.coalesce("_f", "_later")}).drop("_b", "_earlier", "_later")


def _between(x: str) -> Column:
    """Straight line between the known rows around, measured along ``x``."""
    p, f = F.col("_p"), F.col("_f")
    here = F.col("_n") if x == "n" else F.col("_a")
    share = (here - p[x]).cast("double") / (f[x] - p[x])
    return p["v"] + (f["v"] - p["v"]) * share


def fill_linear(df: DataFrame, key, order: str, col: str, out: str | None = None, *, block_rows: int | None = None) -> DataFrame:
    """Linear by row position inside; the first and last known values extend to the ends."""
    marked = neighbours(df, key, order, col, F.lit(0), block_rows)
    filled = F.coalesce(F.col(col).cast("double"), _between("n"), F.col("_p")["v"], F.col("_f")["v"])
    return marked.withColumn(out or col, filled).drop("_n", "_a", "_p", "_f")


def fill_time(df: DataFrame, key, order: str, col: str, out: str, limit: int | None = 2, ends: bool = True, *, block_rows: int | None = None) -> DataFrame:
    """Linear in time for rows at most ``limit`` rows away from a known one.

    With ``ends`` the nearest known value extends past both ends (within ``limit``);
    ``limit=None, ends=False`` fills every interior gap and nothing else.
    """
    marked = neighbours(df, key, order, col, position(order), block_rows)
    back, ahead = F.col("_n") - F.col("_p")["n"], F.col("_f")["n"] - F.col("_n")
    value = _between("a")
    if ends:
        value = F.coalesce(value, F.col("_p")["v"], F.col("_f")["v"])
    if limit is not None:
        value = F.when(F.coalesce(back <= limit, F.lit(False)) | F.coalesce(ahead <= limit, F.lit(False)), value)
    return marked.withColumn(out, F.coalesce(F.col(col).cast("double"), value)).drop("_n", "_a", "_p", "_f")


def _rolled(df: DataFrame, key, order: str, reach: int, block_rows: int | None, made) -> DataFrame:
    """Adds ``made(key, order)``, columns over frames of up to ``reach`` rows before."""
    if block_rows is None:
        return df.withColumns(made(key, order))
    rows, block = _blocks(df, key, order, reach, block_rows)
    return _own_rows(rows.withColumns(made(block, "_n")))


def rolling_rows(df: DataFrame, key, order: str, specs: Sequence[tuple[str, int, str, str]], *, block_rows: int | None = None) -> DataFrame:
    """Count-based rolling aggregates; each spec is (col, n, agg, out).

    NULL until ``n`` rows exist and wherever the frame holds a NULL.
    """

    def made(key, order) -> dict[str, Column]:
        out = {}
        for col, n, agg, name in specs:
            frame = _forward(key, order).rowsBetween(-(n - 1), 0)
            out[name] = F.when(F.count(col).over(frame) == n, _AGGREGATES[agg](col).over(frame))
        return out

    return _rolled(df, key, order, max(n for _, n, _, _ in specs) - 1, block_rows, made)


def event_history(df: DataFrame, key, order: str, col: str, windows: dict[str, int], include_current: bool = True, *, block_rows: int | None = None) -> DataFrame:
    """Rolling event totals, 0 while the window is not full.

    ``include_current=False`` leaves the row's own day out, as training on the same
    day's label requires.
    """

    def made(key, order) -> dict[str, Column]:
        out = {}
        for name, n in windows.items():
            first, last = (-(n - 1), 0) if include_current else (-n, -1)
            frame = _forward(key, order).rowsBetween(first, last)
            out[name] = F.coalesce(F.when(F.count(col).over(frame) == n, F.sum(col).over(frame)), F.lit(0))
        return out

    return _rolled(df, key, order, max(windows.values()), block_rows, made)


def rolling_days(df: DataFrame, key, order: str, specs: Sequence[tuple[str, int, int, str]], *, block_rows: int | None = None) -> DataFrame:
    """Calendar rolling means over ``(t - days, t]``; each spec is (col, days, min_known, out)."""

    def made(key, order) -> dict[str, Column]:
        out = {}
        for col, days, least, name in specs:
            frame = Window.partitionBy(*_cols(key)).orderBy("_day").rangeBetween(-(days - 1), 0)
            out[name] = F.when(F.count(col).over(frame) >= least, F.avg(col).over(frame))
        return out

    # With one row a day, the days a frame reaches back hold no more rows than days.
    return _rolled(df.withColumn("_day", position(order)), key, order, max(days for _, days, _, _ in specs) - 1, block_rows, made).drop("_day")


def missing_streak(df: DataFrame, key, order: str, col: str, flag: str, out: str, *, block_rows: int | None = None) -> DataFrame:
    """``flag``: 1 where missing; ``out``: length of the current run of missing rows, else 0."""
    if block_rows is not None:
        marked = neighbours(df.withColumn(flag, F.col(col).isNull().cast("int")), key, order, col, F.lit(0), block_rows)
        return marked.withColumn(out, (F.col("_n") - F.coalesce(F.col("_p")["n"], F.lit(0))).cast("int")).drop("_n", "_a", "_p", "_f")
    df = df.withColumns({flag: F.col(col).isNull().cast("int"), "_n": F.row_number().over(_forward(key, order))})
    last_known = F.max(F.when(F.col(flag) == 0, F.col("_n"))).over(_seen(key, order))
    return df.withColumn(out, (F.col("_n") - F.coalesce(last_known, F.lit(0))).cast("int")).drop("_n")


def vegetation_features(df: DataFrame, key=("latitude", "longitude"), order: str = "date", col: str = "ndvi", limit: int = 2, *, block_rows: int | None = None) -> DataFrame:
    """Small-gap fill, missingness and 7/21-day means of a vegetation series."""
    df = fill_time(df, key, order, col, f"{col}_interp", limit, block_rows=block_rows)
    df = missing_streak(df, key, order, col, f"{col}_missing_flag", f"{col}_missing_streak", block_rows=block_rows)
    df = rolling_days(df, key, order, [(f"{col}_interp", 7, 3, f"{col}_7d_mean"), (f"{col}_interp", 21, 7, f"{col}_21d_mean")], block_rows=block_rows)
    return df.withColumn(f"{col}_drop", F.col(f"{col}_7d_mean") - F.col(f"{col}_21d_mean"))


def densify_cube(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude", date: str = "date") -> DataFrame:
    """Every (date, lat, lon) of the axes seen in ``df``, its columns NULL where it has no row.

    The longitudes start the rows; days and latitudes, which are as many as the
    calendar and one meridian hold, are generated inside each.  Rows with a NULL
    coordinate have no place in the cube and are left out.
    """
    known = df.na.drop(subset=[date, lat, lon])
    axes = known.agg(F.sort_array(F.collect_set(date)).alias("_days"), F.sort_array(F.collect_set(lat)).alias("_lats"))
    axes = axes.select(F.struct("_days", "_lats").alias("_axes")).scalar()
    # Dealt out again: the longitudes are so few bytes that their groups meet in one task, which would write the whole cube.
    meridians = known.select(lon).distinct().repartition(shuffle_width(df.sparkSession), F.xxhash64(lon))
    columns = meridians.withColumn(lat, F.explode(axes["_lats"])).withColumn(date, F.explode(axes["_days"]))
    rest = [c for c in df.columns if c not in (date, lat, lon)]
    stacked = columns.select(date, lat, lon, F.lit(True).alias("_dense")).unionByName(known, allowMissingColumns=True)
    merged = stacked.groupBy(date, lat, lon).agg(*[F.max(c).alias(c) for c in rest])
    return merged.select(*df.columns)


def fill_cube(df: DataFrame, col: str, out: str, *, lat: str = "latitude", lon: str = "longitude", date: str = "date") -> DataFrame:
    """Fill a (date, lat, lon) cube: in time, then nearest along latitude, then along longitude.

    Absent places are added first: what is filled into them along a meridian counts
    when their parallel is filled.  Interior only, ties to the lower coordinate;
    positions that never had a value stay NULL.
    """
    timed = fill_time(densify_cube(df, lat=lat, lon=lon, date=date), [lat, lon], date, col, "_t", limit=None, ends=False)
    ever = F.max(F.col(col).isNotNull()).over(Window.partitionBy(lat, lon))
    timed = timed.withColumn("_ever", ever)
    down = fill_nearest_along(timed, [date, lon], lat, "_t", "_u")
    across = fill_nearest_along(down, [date, lat], lon, "_u", "_w")
    return across.withColumn(out, F.when(F.col("_ever"), F.col("_w"))).drop("_t", "_u", "_w", "_ever")


def fill_nearest_along(df: DataFrame, key, axis: str, col: str, out: str, *, block_rows: int | None = None) -> DataFrame:
    """Nearest known value along ``axis`` between two known ones; ties to the lower coordinate."""
    marked = neighbours(df, key, axis, col, F.col(axis).cast("double"), block_rows)
    p, f = F.col("_p"), F.col("_f")
    nearest = F.when(F.col("_a") - p["a"] <= f["a"] - F.col("_a"), p["v"]).otherwise(f["v"])
    inside = F.when(p.isNotNull() & f.isNotNull(), nearest)
    return marked.withColumn(out, F.coalesce(F.col(col), inside)).drop("_n", "_a", "_p", "_f")
