"""Views that give the given tables the roles of the panel inputs, in Spark and in SQL.

Every row of a table takes its role: positions follow from keys by fixed
arithmetic that spreads them evenly, the calendar spans the readings.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators.panel import build_panel, densify

# Steps of the even spread.
STEP_LON, STEP_LAT = 0.7548776662466927, 0.5698402909980532
FACTORS = {"click": "PRECTOTCORR", "error": "PS", "purchase": "RH2M", "signup": "T2M", "view": "WS10M"}
WEATHER = list(FACTORS.values())
BBOX = (-124.48, 32.53, -123.15, 34.5)

# A concave outline with a hole, degrees.
OUTLINE = [
    (0, False, [(-124.4, 32.5), (-123.3, 32.7), (-123.6, 33.4), (-123.2, 34.4), (-124.0, 33.9), (-124.5, 34.3), (-124.4, 32.5)]),
    (1, True, [(-124.2, 32.9), (-123.8, 33.0), (-124.0, 33.5), (-124.2, 32.9)]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar_span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """First and last day of the readings: one row."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    return first, last


def spread(low: float, width: float, key: str, step: float) -> Column:
    """Evenly spread values in [low, low + width) from integer keys."""
    return F.expr(f"{low!r}D + {width!r}D * (({key}) * {step!r}D - floor(({key}) * {step!r}D))")


def place(key: str) -> dict[str, Column]:
    return {"lat": spread(32.4, 2.2, key, STEP_LAT), "lon": spread(-124.6, 1.5, key, STEP_LON)}


def terrain_place(key: str) -> tuple[Column, Column]:
    """(lon, lat) inside a half-degree box."""
    return spread(-121.5, 0.5, key, STEP_LON), spread(38.1, 0.4, key, STEP_LAT)


def place_sql(key: str) -> str:
    return (
        f"32.4e0 + 2.2e0 * (({key}) * {STEP_LAT}e0 - floor(({key}) * {STEP_LAT}e0)) as lat, "
        f"-124.6e0 + 1.5e0 * (({key}) * {STEP_LON}e0 - floor(({key}) * {STEP_LON}e0)) as lon"
    )


def outline(spark: SparkSession) -> DataFrame:
    from terrapanel.operators.polygons import RINGS_SCHEMA

    return spark.createDataFrame(OUTLINE, RINGS_SCHEMA)


def outline_edges_sql() -> str:
    edges = [(*a, *b) for _, _, ring in OUTLINE for a, b in zip(ring, ring[1:])]
    return "edges(x1, y1, x2, y2) as (values " + ", ".join("(" + ", ".join(f"cast({v} as double)" for v in e) + ")" for e in edges) + ")"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell for each supplier, between the places of the points."""
    spot = place("s_suppkey + 0.5D")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("grid_id"), *[c.alias(n) for n, c in spot.items()])


CELLS = f"cells as (select s_suppkey as grid_id, {place_sql('s_suppkey + 0.5e0')} from supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[c.alias(n) for n, c in place("c_custkey").items()])


POINTS = f"points as (select c_custkey as id, {place_sql('c_custkey')} from customer)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, date, factor, value): sparse daily readings of every series."""
    from terrapanel.functions.columns import literal_map

    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("grid_id"), F.col("ts").cast("date").alias("date"), literal_map(FACTORS)[F.col("event_type")].alias("factor"), "value"
    )


_FACTOR_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in FACTORS.items()) + " end"
OBS = f"obs as (select user_id as grid_id, cast(ts as date) as date, {_FACTOR_CASE} as factor, value from events)"


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, date, ndvi): the days of every series that were read; one series for each site and factor."""
    obs = observations(spark, sf_dir)
    number = F.col("grid_id") * len(WEATHER) + F.array_position(F.array(*[F.lit(f) for f in WEATHER]), F.col("factor")) - 1
    return obs.groupBy(number.cast("long").alias("grid_id"), "date").agg((F.avg("value") / 500.0).alias("ndvi"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, date, ndvi): one row per series and calendar day, NULL where nothing was read."""
    daily = daily_series(spark, sf_dir)
    return build_panel(densify(daily.select("grid_id").distinct(), *calendar_span(spark, sf_dir)), [daily])


_FIRST_SQL = "(select cast(min(ts) as date) from events)"
_DAYS_SQL = "(select date_diff('day', cast(min(ts) as date), cast(max(ts) as date)) + 1 from events)"
CALENDAR = "days as (select cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as date from (select cast(min(ts) as date) as d0, cast(max(ts) as date) as d1 from events))"
DAILY = f"""{OBS}, daily as (select grid_id * {len(WEATHER)} + list_position([{', '.join(f"'{f}'" for f in WEATHER)}], factor) - 1 as grid_id, date, avg(value) / 500e0 as ndvi
from obs group by 1, 2)"""
SERIES = f"""{DAILY}, {CALENDAR},
series as (select c.grid_id, d.date, daily.ndvi from (select distinct grid_id from daily) c cross join days d left join daily on daily.grid_id = c.grid_id and daily.date = d.date)"""


def shifted_day(spark: SparkSession, sf_dir: str, day: Column) -> Column:
    """Order days laid out in turn over the readings' calendar."""
    first, last = calendar_span(spark, sf_dir)
    return F.date_add(F.lit(first), (F.datediff(day, F.lit("1995-01-01").cast("date")) % ((last - first).days + 1)).cast("int"))


def shifted_day_sql(day: str) -> str:
    return f"({_FIRST_SQL} + cast(date_diff('day', date '1995-01-01', cast({day} as date)) % {_DAYS_SQL} as integer))"


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, lat, lon) of all orders."""
    where = place("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), shifted_day(spark, sf_dir, F.col("o_orderdate")).cast("date").alias("date"), *[c.alias(n) for n, c in where.items()])


INCIDENTS = f"""incidents as (select o_orderkey as id, cast({shifted_day_sql('o_orderdate')} as date) as date, {place_sql('o_custkey')} from orders)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score) of the labelled documents; many scores tie."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").join(documents, "doc_id")
    return joined.select("doc_id", F.col("quality").alias("label"), F.round(F.col("n_chars") / 50.0, 0).alias("score"))


SCORED = "scored as (select l.doc_id, l.quality as label, round(d.n_chars / 50e0, 0) as score from labels l join documents d on d.doc_id = l.doc_id)"


# SQL forms of the projections, from first principles.

_CRS_SQL = {"EPSG:3310": (34.0, 40.5, 0.0, -120.0, -4000000.0), "EPSG:5070": (29.5, 45.5, 23.0, -96.0, 0.0)}


def q_sql(s: str) -> str:
    return f"((1 - e2) * (({s}) / (1 - e2 * ({s}) * ({s})) - ln((1 - e * ({s})) / (1 + e * ({s}))) / (2 * e)))"


def cone_sql(crs: str, name: str = "cone") -> str:
    """CTE with one row of projection constants."""
    p1, p2, p0, l0, fn = _CRS_SQL[crs]

    def m2(v: float) -> str:
        return f"(pow(cos(radians({v}e0)), 2) / (1 - e2 * pow(sin(radians({v}e0)), 2)))"

    def q(v: float) -> str:
        return q_sql(f"sin(radians({v}e0))")

    flat = "(1e0 / 298.257222101e0)"
    return f"""{name} as (select *, a * sqrt(c - n * q0) / n as rho0 from (select *, ma + n * qa as c from (select *, (ma - mb) / (qb - qa) as n from (
  select a, e2, e, fn, l0, {m2(p1)} as ma, {m2(p2)} as mb, {q(p1)} as qa, {q(p2)} as qb, {q(p0)} as q0, {q_sql('1e0')} as qp from (
  select 6378137e0 as a, sqrt(2 * {flat} - {flat} * {flat}) as e, 2 * {flat} - {flat} * {flat} as e2, cast({fn} as double) as fn, radians({l0}e0) as l0)))))"""


def forward_sql(source: str, lon: str = "lon", lat: str = "lat", cone: str = "cone", x: str = "x", y: str = "y") -> str:
    """SELECT adding projected coordinates to every row of ``source``."""
    rho = f"(a * sqrt(c - n * {q_sql(f'sin(radians({lat}))')}) / n)"
    theta = f"(n * (radians({lon}) - l0))"
    return f"select s.*, {rho} * sin({theta}) as {x}, rho0 - {rho} * cos({theta}) + fn as {y} from {source} s cross join {cone} k"


def inverse_sql(source: str, x: str = "x", y: str = "y", cone: str = "cone", lon: str = "lon_", lat: str = "lat_") -> str:
    """SELECT adding lon/lat; latitude by repeated Newton steps."""
    start = f"""select s.*, degrees(atan2({x}, rho0 - ({y} - fn)) / n + l0) as {lon}, (c - (pow({x}, 2) + pow(rho0 - ({y} - fn), 2)) * n * n / (a * a)) / n as _q, e2 as _e2, e as _e
      from {source} s cross join {cone} k"""
    body = f"select *, asin(_q / 2) as _phi from ({start})"
    for _ in range(6):
        q = q_sql("sin(_phi)").replace("e2", "_e2").replace("(2 * e)", "(2 * _e)").replace(" e * ", " _e * ")
        body = f"select * replace (_phi + pow(1 - _e2 * pow(sin(_phi), 2), 2) / (2 * cos(_phi)) * ((_q - {q}) / (1 - _e2)) as _phi) from ({body})"
    return f"select * exclude (_q, _e2, _e, _phi), degrees(_phi) as {lat} from ({body})"


def haversine_sql(a: str, b: str) -> str:
    return (
        f"6371e0 * 2 * asin(sqrt(least(1e0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
        f"* pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
    )


def nearest_sql(points_name: str, key: str, out: str, cells_name: str = "cells") -> str:
    """CTE: every row of ``points_name`` with its nearest cell."""
    return f"""{out} as (select * exclude (rk) from (select p.*, c.grid_id, {haversine_sql('p', 'c')} as dist_km,
  row_number() over (partition by p.{key} order by round({haversine_sql('p', 'c')}, 9), c.grid_id) as rk from {points_name} p cross join {cells_name} c) where rk = 1)"""
