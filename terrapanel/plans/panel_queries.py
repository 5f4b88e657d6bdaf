"""Panel assembly, labels, gap filling, rolling features and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.columns import in_season, with_interactions, with_seasonal
from terrapanel.functions.geo import albers_forward
from terrapanel.operators import qa
from terrapanel.operators.grid import cell_of
from terrapanel.operators.panel import (
    build_examples,
    build_labels,
    build_panel,
    cell_day_count,
    cell_day_mean,
    daily_totals,
    densify_observed,
    keep_covered,
    merge_factors,
    with_static,
)
from terrapanel.operators.spatial import assign_nearest
from terrapanel.operators.timeseries import event_history, fill_linear, fill_time, missing_streak, rolling_days, rolling_rows, vegetation_features
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.roles import WEATHER, calendar_span, place, place_sql, table
from terrapanel.session import cut_lineage

_FACTOR_SHAPE = " ".join(f"{f}:f6" for f in WEATHER)
_CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


# Factor merges.

_PER_FACTOR = ", ".join(f"f_{f} as (select grid_id, date, avg(value) as {f} from obs where factor = '{f}' group by 1, 2)" for f in WEATHER)


def _merge_sql(kind: str) -> str:
    joins = " ".join(f"{kind} join f_{f} using (grid_id, date)" for f in WEATHER[1:])
    return f"with {roles.OBS}, {_PER_FACTOR} select grid_id, date, {', '.join(WEATHER)} from f_{WEATHER[0]} {joins}"


def _factor_means(spark, sf_dir):
    return cell_day_mean(roles.observations(spark, sf_dir), ["grid_id", "date", "factor"], ["value"])


@register("factor_inner_merge", f"grid_id:l date:d {_FACTOR_SHAPE}", _merge_sql("inner"))
def factor_inner_merge(spark, sf_dir):
    return merge_factors(_factor_means(spark, sf_dir), ["grid_id", "date"], "factor", "value", WEATHER)


@register("factor_outer_merge", f"grid_id:l date:d {_FACTOR_SHAPE}", _merge_sql("full outer"))
def factor_outer_merge(spark, sf_dir):
    return merge_factors(_factor_means(spark, sf_dir), ["grid_id", "date"], "factor", "value", WEATHER, how="outer")


# The daily panel.

_PANEL = f"""{roles.CELLS}, {roles.OBS}, sites as (select grid_id as id, {place_sql('grid_id')} from (select distinct grid_id from obs)),
{roles.nearest_sql('sites', 'id', 'site_at')}, located as (select a.grid_id, o.date, o.factor, o.value from obs o join site_at a on a.id = o.grid_id),
weather as (select grid_id, date, {', '.join(f"avg(value) filter (where factor = '{f}') as {f}" for f in WEATHER)} from located group by 1, 2),
veg as (select grid_id, date, avg(value / 500e0) as ndvi from located where factor = 'WS10M' group by 1, 2),
{roles.INCIDENTS}, {roles.nearest_sql('incidents', 'id', 'fire_at')}, fires as (select grid_id, date, 1 as fire_today from fire_at group by 1, 2),
lc as (select p_partkey as id, p_type, {place_sql('p_partkey')} from part), {roles.nearest_sql('lc', 'id', 'lc_at')},
cover as (select grid_id, {', '.join(f"100e0 * count(*) filter (where p_type = '{c}') / count(*) as pct_{c}" for c in _CLASSES)} from lc_at group by 1),
panel as (select c.grid_id, d.date, {', '.join(WEATHER)}, ndvi, coalesce(fire_today, 0) as fire_today, {', '.join(f'pct_{c}' for c in _CLASSES)}
  from cells c cross join (select distinct date from weather) d left join weather w on w.grid_id = c.grid_id and w.date = d.date
  left join veg v on v.grid_id = c.grid_id and v.date = d.date left join fires f on f.grid_id = c.grid_id and f.date = d.date left join cover l on l.grid_id = c.grid_id)"""
_PANEL_SHAPE = f"grid_id:l date:d {_FACTOR_SHAPE} ndvi:f6 fire_today:l " + " ".join(f"pct_{c}:f6" for c in _CLASSES)


def build_daily_panel(spark, sf_dir):
    """Weather, vegetation, incidents and land cover snapped to their nearest cells, every cell on every weather day."""
    cells = roles.cells(spark, sf_dir)
    obs = roles.observations(spark, sf_dir).withColumnRenamed("grid_id", "id")
    sites = obs.select("id").distinct().select(F.lit("site").alias("kind"), "id", *[c.alias(n) for n, c in place("id").items()])
    fires = roles.incidents(spark, sf_dir).select(F.lit("fire").alias("kind"), "id", "lat", "lon", "date")
    pixels = table(spark, sf_dir, "part").select(F.lit("pixel").alias("kind"), *[c.alias(n) for n, c in place("p_partkey").items()], "p_type")
    # All sources look for their cells together; the result serves three aggregates.
    stacked = sites.unionByName(fires, allowMissingColumns=True).unionByName(pixels, allowMissingColumns=True)
    located = cut_lineage(assign_nearest(stacked, cells).drop("lat", "lon", "dist_km"))
    reading, factor = F.col("value"), F.col("factor")
    parts = {f: F.when(factor == f, reading) for f in WEATHER} | {"ndvi": F.when(factor == "WS10M", reading / 500.0)}
    # One row per site and day before any join: a busy site costs no more than a quiet one.
    daily = obs.groupBy("id", "date").agg(*[agg(v).alias(f"{k}_{n}") for k, agg in (("s", F.sum), ("n", F.count)) for n, v in parts.items()])
    at_cells = daily.join(located.where("kind = 'site'").select("id", "grid_id"), "id")
    facts = at_cells.groupBy("grid_id", "date").agg(*[F.try_divide(F.sum(f"s_{n}"), F.sum(f"n_{n}").cast("double")).alias(n) for n in parts])
    fires = cell_day_count(located.where("kind = 'fire'")).select("grid_id", "date", F.lit(1).alias("fire_today"))
    shares = [((F.col("p_type") == c).cast("double") * 100).alias(f"pct_{c}") for c in _CLASSES]
    cover = cell_day_mean(located.where("kind = 'pixel'").select("grid_id", *shares), ["grid_id"])
    scaffold = densify_observed(cells, roles.observations(spark, sf_dir))
    return with_static(build_panel(scaffold, [facts, fires], zero_fill=["fire_today"]), cover)


@register("daily_panel", _PANEL_SHAPE, f"with {_PANEL} select * from panel")
def daily_panel(spark, sf_dir):
    return build_daily_panel(spark, sf_dir)


_ROLLS = [("T2M", 3, "mean", "T2M_3d_mean"), ("RH2M", 3, "min", "RH2M_3d_min"), ("WS10M", 3, "max", "WS10M_3d_max"), ("PRECTOTCORR", 7, "sum", "PRECTOT_7d_sum"), ("ndvi", 7, "mean", "ndvi_7d_mean")]


def _linear_sql(source: str, out: str, col: str) -> str:
    """CTEs that fill ``col`` of ``source`` by row position, ends extended."""
    back = "over (partition by grid_id order by date rows between unbounded preceding and current row)"
    ahead = "over (partition by grid_id order by date rows between current row and unbounded following)"
    return f"""{out}_n as (select *, row_number() over (partition by grid_id order by date) as n from {source}),
{out}_p as (select *, last_value({col} ignore nulls) {back} as pv, last_value(case when {col} is not null then n end ignore nulls) {back} as pn,
  first_value({col} ignore nulls) {ahead} as nv, first_value(case when {col} is not null then n end ignore nulls) {ahead} as nn from {out}_n),
{out} as (select * exclude ({col}, n, pv, pn, nv, nn), case when {col} is not null then {col} when pv is null then nv when nv is null then pv
  else pv + (nv - pv) * ((n - pn) / cast(nn - pn as double)) end as {col} from {out}_p)"""


def _frame_sql(col: str, n: int, agg: str, out: str) -> str:
    w = f"over (partition by grid_id order by date rows between {n - 1} preceding and current row)"
    name = {"mean": "avg"}.get(agg, agg)
    return f"case when count({col}) {w} = {n} then {name}({col}) {w} end as {out}"


@register(
    "training_panel",
    _PANEL_SHAPE + " " + " ".join(f"{o}:f6" for *_, o in _ROLLS) + " fires_last_7d:l fires_last_14d:l",
    f"""with {_PANEL}, ok as (select grid_id from panel group by 1 having count(PRECTOTCORR) > 0 and count(pct_SMALL) > 0),
    covered as (select * from panel where grid_id in (select grid_id from ok)), {_linear_sql('covered', 'filled', 'ndvi')}
    select * from (select *, {', '.join(_frame_sql(*r) for r in _ROLLS)}, coalesce({_frame_sql('fire_today', 7, 'sum', 'x')[:-5]}, 0) as fires_last_7d,
    coalesce({_frame_sql('fire_today', 14, 'sum', 'x')[:-5]}, 0) as fires_last_14d from filled) where PRECTOTCORR is not null""",
)
def training_panel(spark, sf_dir):
    return build_training_panel(build_daily_panel(spark, sf_dir))


def build_training_panel(panel):
    """Covered cells, vegetation gaps filled, rolling weather and event history, rows with weather only."""
    covered = keep_covered(panel, "grid_id", ["PRECTOTCORR", "pct_SMALL"])
    filled = fill_linear(covered, "grid_id", "date", "ndvi")
    rolled = rolling_rows(filled, "grid_id", "date", _ROLLS)
    return event_history(rolled, "grid_id", "date", "fire_today", {"fires_last_7d": 7, "fires_last_14d": 14}).na.drop(subset=["PRECTOTCORR"])


@register(
    "valid_cells",
    "grid_id:l date:d T2M:f6 PS:f6",
    f"""with {roles.OBS}, w as (select grid_id, date, avg(value) filter (where factor = 'T2M' and value > 60) as T2M, avg(value) filter (where factor = 'PS' and value > 80) as PS from obs group by 1, 2)
    select * from w where grid_id in (select grid_id from w where T2M is not null) and grid_id in (select grid_id from w where PS is not null)""",
)
def valid_cells(spark, sf_dir):
    v, f = F.col("value"), F.col("factor")
    wide = roles.observations(spark, sf_dir).groupBy("grid_id", "date").agg(
        F.avg(F.when((f == "T2M") & (v > 60), v)).alias("T2M"), F.avg(F.when((f == "PS") & (v > 80), v)).alias("PS")
    )
    return keep_covered(wide, "grid_id", ["T2M", "PS"])


# Labels on a projected grid.

_SQUARES = f"""{roles.POINTS}, {roles.cone_sql('EPSG:3310')}, pxy as ({roles.forward_sql('points')}),
sq as (select id, lat, lon, cast(floor(x / 5000) as bigint) * 1000000 + cast(floor(y / 5000) as bigint) as grid_id from pxy),
squares as (select grid_id, avg(lat) as centroid_lat, avg(lon) as centroid_lon from sq group by 1),
{roles.INCIDENTS}, ixy as ({roles.forward_sql('incidents')}),
events_on_cells as (select date, cast(floor(x / 5000) as bigint) * 1000000 + cast(floor(y / 5000) as bigint) as grid_id from ixy),
{roles.CALENDAR},
label_panel as (select d.date, s.grid_id, case when e.grid_id is null then 0 else 1 end as fire_today from squares s cross join days d
  left join (select distinct date, grid_id from events_on_cells) e on e.grid_id = s.grid_id and e.date = d.date)"""


def _square(df):
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    i, j = cell_of(x, y, 0.0, 0.0, 5000.0)
    return df.withColumn("grid_id", i * 1_000_000 + j)


def _squares(spark, sf_dir):
    """Cells: the 5 km squares that hold at least one point, at their mean position."""
    return _square(roles.points(spark, sf_dir)).groupBy("grid_id").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))


def _events_on_cells(spark, sf_dir):
    return _square(roles.incidents(spark, sf_dir)).select("date", "grid_id")


def _labels(spark, sf_dir):
    return build_labels(_events_on_cells(spark, sf_dir), _squares(spark, sf_dir), *calendar_span(spark, sf_dir))


@register("label_panel", "date:d grid_id:l fire_today:l", f"with {_SQUARES} select * from label_panel")
def label_panel(spark, sf_dir):
    return _labels(spark, sf_dir)


def _detections(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    spots = items.select(roles.shifted_day(spark, sf_dir, F.col("l_shipdate")).cast("date").alias("date"), code.alias("conf"), *[c.alias(n) for n, c in place("l_partkey").items()])
    return _square(spots).select("date", "grid_id", "conf")


@register(
    "examples_panel",
    "date:d grid_id:l fire_today:l irwin_incidents:l firms_detections:l firms_conf_max:l centroid_lat:f6 centroid_lon:f6",
    f"""with {_SQUARES}, spots as (select cast({roles.shifted_day_sql('l_shipdate')} as date) as date, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as conf, {place_sql('l_partkey')}
      from lineitem), dxy as ({roles.forward_sql('spots')}),
    det as (select date, cast(floor(x / 5000) as bigint) * 1000000 + cast(floor(y / 5000) as bigint) as grid_id, count(*) as firms_detections, max(conf) as firms_conf_max from dxy group by 1, 2),
    inc as (select date, grid_id, count(*) as irwin_incidents from events_on_cells group by 1, 2)
    select l.date, l.grid_id, fire_today, coalesce(irwin_incidents, 0) as irwin_incidents, coalesce(firms_detections, 0) as firms_detections, coalesce(firms_conf_max, 0) as firms_conf_max, centroid_lat, centroid_lon
    from label_panel l left join inc on inc.date = l.date and inc.grid_id = l.grid_id left join det on det.date = l.date and det.grid_id = l.grid_id join squares s on s.grid_id = l.grid_id""",
)
def examples_panel(spark, sf_dir):
    return build_examples(_events_on_cells(spark, sf_dir), _detections(spark, sf_dir), _squares(spark, sf_dir), *calendar_span(spark, sf_dir))


@register(
    "daily_totals",
    "date:d fire_today:l irwin_incidents:l firms_detections:l",
    f"""with {_SQUARES}, spots as (select cast({roles.shifted_day_sql('l_shipdate')} as date) as date, {place_sql('l_partkey')} from lineitem), dxy as ({roles.forward_sql('spots')}),
    det as (select date, count(*) as n from dxy where cast(floor(x / 5000) as bigint) * 1000000 + cast(floor(y / 5000) as bigint) in (select grid_id from squares) group by 1),
    inc as (select date, count(*) as n from events_on_cells where grid_id in (select grid_id from squares) group by 1)
    select l.date, sum(fire_today) as fire_today, coalesce(max(inc.n), 0) as irwin_incidents, coalesce(max(det.n), 0) as firms_detections from label_panel l left join inc on inc.date = l.date left join det on det.date = l.date group by 1""",
)
def daily_totals_query(spark, sf_dir):
    examples = build_examples(_events_on_cells(spark, sf_dir), _detections(spark, sf_dir), _squares(spark, sf_dir), *calendar_span(spark, sf_dir))
    return daily_totals(examples, ["fire_today", "irwin_incidents", "firms_detections"])


@register(
    "season_filter",
    "o_orderkey:l date:d",
    "select o_orderkey, cast(o_orderdate as date) as date from orders where month(o_orderdate) in (6, 7, 8, 9) and year(o_orderdate) = 1998",
)
def season_filter(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where(in_season(day, 1998, (6, 9))).select("o_orderkey", day.alias("date"))


@register("labels_with_coordinates", "date:d grid_id:l fire_today:l centroid_lat:f6 centroid_lon:f6", f"with {_SQUARES} select * from label_panel join squares using (grid_id)")
def labels_with_coordinates(spark, sf_dir):
    return with_static(_labels(spark, sf_dir), _squares(spark, sf_dir))


# Gaps and windows.


@register("gap_fill_linear", "grid_id:l date:d ndvi:f6", f"with {roles.SERIES}, {_linear_sql('series', 'filled', 'ndvi')} select * from filled")
def gap_fill_linear(spark, sf_dir):
    return fill_linear(roles.series(spark, sf_dir), "grid_id", "date", "ndvi")


_LONG = """with e as (select event_type, event_id, case when event_id % 7 <> 0 then value end as v, cast(value > 50 as integer) as hit, row_number() over (partition by event_type order by event_id) as n from events),
m as (select *, last_value(v ignore nulls) over b as pv, last_value(case when v is not null then n end ignore nulls) over b as pn, first_value(v ignore nulls) over f as nv, first_value(case when v is not null then n end ignore nulls) over f as nn
  from e window b as (partition by event_type order by event_id rows between unbounded preceding and current row), f as (partition by event_type order by event_id rows between current row and unbounded following))
select event_type, event_id, coalesce(v, pv + (nv - pv) * ((n - pn) / cast(nn - pn as double)), pv, nv) as filled, case when count(v) over w7 = 7 then avg(v) over w7 end as mean7,
  case when count(*) over w14 = 14 then sum(hit) over w14 else 0 end as last14, case when v is null then n - coalesce(pn, 0) else 0 end as streak
from m window w7 as (partition by event_type order by event_id rows between 6 preceding and current row), w14 as (partition by event_type order by event_id rows between 13 preceding and current row)"""


@register("long_series", "event_type:s event_id:l filled:f6 mean7:f6 last14:l streak:l", _LONG)
def long_series(spark, sf_dir):
    """Series that are longer than a task should hold, a thousand rows at a time."""
    held = {"block_rows": 1000}
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    events = table(spark, sf_dir, "events").select("event_type", "event_id", value.alias("v"), (F.col("value") > 50).cast("int").alias("hit"))
    filled = fill_linear(events, "event_type", "event_id", "v", "filled", **held)
    rolled = rolling_rows(filled, "event_type", "event_id", [("v", 7, "mean", "mean7")], **held)
    return missing_streak(event_history(rolled, "event_type", "event_id", "hit", {"last14": 14}, **held), "event_type", "event_id", "v", "flag", "streak", **held)


_BACK = "over (partition by grid_id order by date rows between unbounded preceding and current row)"
_AHEAD = "over (partition by grid_id order by date rows between current row and unbounded following)"
_TIMED = f"""timed_n as (select *, row_number() over (partition by grid_id order by date) as n from {{source}}),
timed_p as (select *, last_value(ndvi ignore nulls) {_BACK} as pv, last_value(case when ndvi is not null then n end ignore nulls) {_BACK} as pn, last_value(case when ndvi is not null then date end ignore nulls) {_BACK} as pd,
  first_value(ndvi ignore nulls) {_AHEAD} as nv, first_value(case when ndvi is not null then n end ignore nulls) {_AHEAD} as nn, first_value(case when ndvi is not null then date end ignore nulls) {_AHEAD} as nd from timed_n),
timed as (select grid_id, date, ndvi, case when ndvi is not null then ndvi when n - pn <= 2 or nn - n <= 2 then
  case when pv is null then nv when nv is null then pv else pv + (nv - pv) * (date_diff('day', pd, date) / cast(date_diff('day', pd, nd) as double)) end end as ndvi_interp from timed_p)"""


@register("gap_fill_time_limit", "grid_id:l date:d ndvi:f6 ndvi_interp:f6", f"with {roles.SERIES}, {_TIMED.format(source='series')} select * from timed")
def gap_fill_time_limit(spark, sf_dir):
    return fill_time(roles.series(spark, sf_dir), "grid_id", "date", "ndvi", "ndvi_interp", 2)


@register(
    "rolling_rows",
    "grid_id:l date:d mean3:f6 min3:f6 max3:f6 sum7:f6",
    f"with {roles.SERIES} select grid_id, date, {_frame_sql('ndvi', 3, 'mean', 'mean3')}, {_frame_sql('ndvi', 3, 'min', 'min3')}, {_frame_sql('ndvi', 3, 'max', 'max3')}, {_frame_sql('ndvi', 7, 'sum', 'sum7')} from series",
)
def rolling_rows_query(spark, sf_dir):
    return rolling_rows(roles.series(spark, sf_dir), "grid_id", "date", [("ndvi", 3, "mean", "mean3"), ("ndvi", 3, "min", "min3"), ("ndvi", 3, "max", "max3"), ("ndvi", 7, "sum", "sum7")])


def _history_sql(n: int, current: bool, out: str) -> str:
    frame = f"rows between {n - 1} preceding and current row" if current else f"rows between {n} preceding and 1 preceding"
    w = f"over (partition by grid_id order by date {frame})"
    return f"case when count(fire_today) {w} = {n} then sum(fire_today) {w} else 0 end as {out}"


@register(
    "event_history",
    "date:d grid_id:l fire_today:l fires_last_7d:l fires_last_14d:l fires_before_7d:l",
    f"with {_SQUARES} select *, {_history_sql(7, True, 'fires_last_7d')}, {_history_sql(14, True, 'fires_last_14d')}, {_history_sql(7, False, 'fires_before_7d')} from label_panel",
)
def event_history_query(spark, sf_dir):
    labels = event_history(_labels(spark, sf_dir), "grid_id", "date", "fire_today", {"fires_last_7d": 7, "fires_last_14d": 14})
    return event_history(labels, "grid_id", "date", "fire_today", {"fires_before_7d": 7}, include_current=False)


@register(
    "rolling_days",
    "grid_id:l date:d mean7:f6 mean21:f6 drop:f6",
    f"""with {roles.DAILY}, r as (select grid_id, date, case when count(ndvi) over w7 >= 3 then avg(ndvi) over w7 end as mean7, case when count(ndvi) over w21 >= 7 then avg(ndvi) over w21 end as mean21 from daily
    window w7 as (partition by grid_id order by date range between interval 6 days preceding and current row), w21 as (partition by grid_id order by date range between interval 20 days preceding and current row))
    select *, mean7 - mean21 as drop from r""",
)
def rolling_days_query(spark, sf_dir):
    """Calendar windows over sparse rows: days without a reading have no row."""
    rolled = rolling_days(roles.daily_series(spark, sf_dir), "grid_id", "date", [("ndvi", 7, 3, "mean7"), ("ndvi", 21, 7, "mean21")])
    return rolled.withColumn("drop", F.col("mean7") - F.col("mean21"))


_STREAK = """flags as (select *, cast(ndvi is null as integer) as ndvi_missing_flag, row_number() over (partition by grid_id order by date) as rn from {source}),
runs as (select *, rn - row_number() over (partition by grid_id, ndvi_missing_flag order by date) as run from flags),
streaks as (select *, case when ndvi_missing_flag = 1 then row_number() over (partition by grid_id, ndvi_missing_flag, run order by date) else 0 end as ndvi_missing_streak from runs)"""


@register(
    "missing_streak", "grid_id:l date:d ndvi_missing_flag:l ndvi_missing_streak:l", f"with {roles.SERIES}, {_STREAK.format(source='series')} select * from streaks"
)
def missing_streak_query(spark, sf_dir):
    return missing_streak(roles.series(spark, sf_dir), "grid_id", "date", "ndvi", "ndvi_missing_flag", "ndvi_missing_streak")


@register(
    "vegetation_features",
    "grid_id:l date:d ndvi:f6 ndvi_interp:f6 ndvi_missing_flag:l ndvi_missing_streak:l ndvi_7d_mean:f6 ndvi_21d_mean:f6 ndvi_drop:f6",
    f"""with {roles.SERIES}, {_TIMED.format(source='series')}, {_STREAK.format(source='timed')},
    r as (select *, case when count(ndvi_interp) over w7 >= 3 then avg(ndvi_interp) over w7 end as ndvi_7d_mean, case when count(ndvi_interp) over w21 >= 7 then avg(ndvi_interp) over w21 end as ndvi_21d_mean from streaks
    window w7 as (partition by grid_id order by date range between interval 6 days preceding and current row), w21 as (partition by grid_id order by date range between interval 20 days preceding and current row))
    select *, ndvi_7d_mean - ndvi_21d_mean as ndvi_drop from r""",
)
def vegetation_features_query(spark, sf_dir):
    return vegetation_features(roles.series(spark, sf_dir), ["grid_id"])


_WIDE = f"""with {roles.OBS}, wide as (select grid_id, date, {', '.join(f"avg(value) filter (where factor = '{f}') as {f}" for f in WEATHER)} from obs group by 1, 2),
f as (select *, PS / 500e0 as ndvi from wide)"""


@register(
    "interactions",
    "grid_id:l date:d vpd_proxy:f6 hot_windy:f6 dry_windy:f6 fuel_moisture_proxy:f6",
    f"{_WIDE} select *, T2M * (100 - RH2M) / 100e0 as vpd_proxy, WS10M * T2M as hot_windy, 100 * WS10M - RH2M * WS10M as dry_windy, RH2M * ndvi as fuel_moisture_proxy from f",
)
def interactions(spark, sf_dir):
    wide = merge_factors(_factor_means(spark, sf_dir), ["grid_id", "date"], "factor", "value", WEATHER, how="outer")
    return with_interactions(wide.withColumn("ndvi", F.col("PS") / 500.0))


@register(
    "seasonal",
    "o_orderkey:l day_sin:f6 day_cos:f6 month_sin:f6 month_cos:f6",
    """select o_orderkey, sin(2 * pi() * dayofyear(o_orderdate) / 366e0) as day_sin, cos(2 * pi() * dayofyear(o_orderdate) / 366e0) as day_cos,
    sin(2 * pi() * month(o_orderdate) / 12e0) as month_sin, cos(2 * pi() * month(o_orderdate) / 12e0) as month_cos from orders""",
)
def seasonal(spark, sf_dir):
    return with_seasonal(table(spark, sf_dir, "orders"), "o_orderdate")


# Audits.


@register("positive_rate", "date:d pos_rate:f9", f"with {_SQUARES} select date, avg(fire_today) as pos_rate from label_panel group by 1")
def positive_rate(spark, sf_dir):
    return qa.positive_rate(_labels(spark, sf_dir))


@register(
    "qa_completeness",
    "cells:l days:l label_rows:l expected_rows:l complete:b",
    f"with {_SQUARES} select (select count(*) from squares) as cells, (select count(*) from days) as days, count(*) as label_rows, (select count(*) from squares) * (select count(*) from days) as expected_rows, count(*) = (select count(*) from squares) * (select count(*) from days) as complete from label_panel",
)
def qa_completeness(spark, sf_dir):
    return qa.completeness(_labels(spark, sf_dir), _squares(spark, sf_dir), *calendar_span(spark, sf_dir))


@register(
    "qa_missing_days",
    "grid_id:l date:d",
    f"""with {roles.OBS}, {roles.CALENDAR} select c.grid_id, d.date from (select distinct grid_id from obs) c cross join days d
    where not exists (select 1 from obs o where o.grid_id = c.grid_id and o.date = d.date)""",
)
def qa_missing_days(spark, sf_dir):
    obs = roles.observations(spark, sf_dir)
    return qa.missing_cell_days(obs.select("grid_id", "date").distinct(), obs.select("grid_id"), *calendar_span(spark, sf_dir))


# Deliberately flawed labels: orders as label rows, two thirds of the values valid, some cells unknown.
_FLAWED = """raw as (select case when o_orderkey % 11 = 0 then 'unknown' else cast(cast(o_orderdate as date) as varchar) end as date, o_custkey as grid_id, o_orderkey % 3 as fire_today from orders),
lookup as (select c_custkey as grid_id from customer where c_acctbal > 0), ev as (select distinct cast(cast(l_shipdate as date) as varchar) as date, l_suppkey as grid_id from lineitem)"""


def _flawed(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    labels = table(spark, sf_dir, "orders").select(day.alias("date"), F.col("o_custkey").alias("grid_id"), (k % 3).cast("int").alias("fire_today"))
    lookup = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("grid_id"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("date"), F.col("l_suppkey").alias("grid_id"))
    return labels, lookup, events


@register(
    "qa_violations",
    "check:s n:l",
    f"""with {_FLAWED} select 'bad_dates' as "check", count(*) as n from raw where try_cast(date as date) is null or try_cast(date as date) not between date '1996-01-01' and date '1999-12-31'
    union all select 'bad_values', count(*) from raw where fire_today not in (0, 1)
    union all select 'missing_grid_ids', count(*) from raw where grid_id not in (select grid_id from lookup)
    union all select 'labels_not_in_events', count(*) from (select distinct date, grid_id from raw where fire_today = 1 except select date, grid_id from ev)""",
)
def qa_violations(spark, sf_dir):
    labels, lookup, events = _flawed(spark, sf_dir)
    checks = {
        "bad_dates": qa.bad_dates(labels, "1996-01-01", "1999-12-31"),
        "bad_values": qa.bad_values(labels),
        "missing_grid_ids": qa.unknown_cells(labels, lookup),
        "labels_not_in_events": qa.positives_without_event(labels, events),
    }
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, rows in checks.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


@register(
    "qa_overview",
    "section:s metric:s value:s",
    f"""with inc as (select {roles.shifted_day_sql('o_orderdate')} as date, o_orderstatus as state, case when o_orderpriority <> '5-LOW' then o_orderpriority end as type from orders)
    select 'incidents' as section, 'rows' as metric, cast(count(*) as varchar) as value from inc union all select 'incidents', 'date_min', cast(cast(min(date) as date) as varchar) from inc
    union all select 'incidents', 'date_max', cast(cast(max(date) as date) as varchar) from inc
    union all select 'type_counts', coalesce(type, ''), cast(count(*) as varchar) from inc group by type union all select 'state_counts', state, cast(count(*) as varchar) from inc group by state""",
)
def qa_overview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return qa.source_overview(orders.select(roles.shifted_day(spark, sf_dir, F.col("o_orderdate")).cast("date").alias("date"), F.col("o_orderstatus").alias("state"), kind.alias("type")))


@register(
    "summary_stats",
    "name:s rows:l missing:l missing_pct:f6 mean:f6 std:f6 min:f6 q25:f6 q50:f6 q75:f6 max:f6",
    "with v as (select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as name, unnest([l_quantity, l_extendedprice, case when l_discount > 0.02e0 then l_discount end]) as value from lineitem) "
    "select name, count(*) as rows, count(*) - count(value) as missing, 100e0 * (count(*) - count(value)) / count(*) as missing_pct, avg(value) as mean, stddev_samp(value) as std, min(value) as min, "
    "quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75, max(value) as max from v group by name",
)
def summary_stats(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    return qa.summary_stats(items, ["l_quantity", "l_extendedprice", "l_discount"])


@register(
    "null_fraction",
    "name:s missing:l rows:l fraction:f9",
    f"{_WIDE} " + " union all ".join(f"select '{c}' as name, count(*) - count({c}) as missing, count(*) as rows, (count(*) - count({c})) / cast(count(*) as double) as fraction from wide" for c in WEATHER),
)
def null_fraction(spark, sf_dir):
    wide = merge_factors(_factor_means(spark, sf_dir), ["grid_id", "date"], "factor", "value", WEATHER, how="outer")
    return qa.null_fraction(wide, WEATHER)


@register(
    "fill_coverage",
    "name:s missing:l rows:l fraction:f9",
    f"""with {roles.SERIES}, {_TIMED.format(source='series')} select 'ndvi' as name, count(*) - count(ndvi) as missing, count(*) as rows, (count(*) - count(ndvi)) / cast(count(*) as double) as fraction from timed
    union all select 'ndvi_interp', count(*) - count(ndvi_interp), count(*), (count(*) - count(ndvi_interp)) / cast(count(*) as double) from timed""",
)
def fill_coverage(spark, sf_dir):
    """Missing readings before and after the small-gap fill."""
    filled = fill_time(roles.series(spark, sf_dir), "grid_id", "date", "ndvi", "ndvi_interp", 2)
    return qa.null_fraction(filled, ["ndvi", "ndvi_interp"])


@register("value_counts", "value:s n:l", "select case when lang <> 'fr' then lang end as value, count(*) as n from documents group by 1")
def value_counts(spark, sf_dir):
    return qa.value_counts(table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang"))), "lang")
