"""Row cleaning: keyed dedupe, incident and detection cleaning, schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import (
    backfill_coordinate,
    confidence_score,
    half_even,
    in_bbox,
    local_window_utc,
    strip_units,
    to_number,
    valid_coordinate,
)
from terrapanel.operators.polygons import within_polygon

# Accepted column names, best first.
ALIASES = {
    "lat": ("lat", "Latitude", "latitude", "InitialLatitude"),
    "lon": ("lon", "Longitude", "longitude", "InitialLongitude"),
    "date": ("date", "local_date", "discovery_date"),
    "fire_time": ("fire_time", "FireDiscoveryDateTime", "fire_time_local"),
}

# Portal column names.
PORTAL_NAMES = {
    "IrwinID": "incident_id",
    "IncidentName": "incident_name",
    "InitialLatitude": "lat",
    "InitialLongitude": "lon",
    "POOState": "state",
    "IncidentTypeCategory": "type",
    "FireDiscoveryDateTime": "fire_time",
}


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Rename the first present alias of each canonical name."""
    chosen = {}
    for name, options in aliases.items():
        present = [o for o in options if o in df.columns]
        if present:
            chosen[present[0]] = name
        elif name in required:
            raise ValueError(f"none of {list(options)} found in {df.columns}")
    return df.withColumnsRenamed({old: new for old, new in chosen.items() if old != new})


def null_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become NULL."""
    floating = [n for n, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in floating})


def coerce_numeric(df: DataFrame, columns: Sequence[str], strip: bool = False) -> DataFrame:
    read = strip_units if strip else to_number
    return df.withColumns({c: read(F.col(c)) for c in columns})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``; NULL keys count as equal.

    The least row is an aggregate and combines before the shuffle: a key with a third
    of all rows (such as NULL) costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = [c for c in order if c not in keys]
    best = F.min(F.struct(*lead, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def state_in(col: Column, states: Sequence[str]) -> Column:
    """``CA`` matches ``US-CA`` and ``CA``; ``US-CA`` only itself."""
    spelled = [s for token in (t.strip() for t in states) if token for s in ([token] if token.startswith("US-") else [f"US-{token}", token])]
    return col.isin(spelled)


@dataclass(frozen=True)
class IncidentColumns:
    """Where an incident table keeps what is asked for."""

    discovered: str = "FireDiscoveryDateTime"
    state: str = "POOState"
    kind: str = "IncidentTypeCategory"


# What a record's status columns hold when it may be used.
RECORD_STATUS = {
    "public": "ADSPermissionState = 'DEFAULT'",
    "valid": "IsValid = 1",
    "released": "IsQuarantined = 0 or IsQuarantinedInIRWIN = 0 or IsQuarantined is null",
}


def incident_filter(
    df: DataFrame, days: tuple[str, str], *, tz: str = "America/Los_Angeles", states: Sequence[str] = (), types: Sequence[str] = (), status: Sequence[str] = (), columns: IncidentColumns = IncidentColumns()
) -> DataFrame:
    """Incidents discovered between two local days, both included, by state, type and the named kinds of record status.

    All tests are plain comparisons on stored columns and reach the scan.
    """
    low, high = local_window_utc(*days, tz)
    tests = [F.col(columns.discovered).between(low, high), *[F.expr(RECORD_STATUS[s]) for s in status]]
    if types:
        tests.append(F.col(columns.kind).isin(list(types)))
    if any(s.strip() for s in states):
        tests.append(state_in(F.col(columns.state), states))
    for test in tests:
        df = df.where(test)
    return df


def clean_portal_incidents(df: DataFrame, state: str = "US-CA", kind: str = "WF") -> DataFrame:
    """Portal export -> (incident_id, date, lat, lon, state, type), the earliest day of each incident."""
    named = df.withColumnsRenamed(PORTAL_NAMES).where((F.col("state") == state) & (F.col("type") == kind))
    dated = named.withColumn("date", F.col("fire_time").try_cast("timestamp").cast("date"))
    out = dated.select("incident_id", "date", "lat", "lon", "state", "type").na.drop(subset=["lat", "lon", "date"])
    return keep_first(out, ["incident_id"], ["date"])


def clean_point_incidents(
    df: DataFrame, start: str, end: str, bbox: Sequence[float], *, state: str | None = "US-CA", boundary: DataFrame | None = None
) -> DataFrame:
    """Incident points -> (date, lat, lon[, incident_id]): coordinates backfilled from x/y, inside dates and area."""
    points = df.withColumns(
        {
            "date": F.col("FireDiscoveryDateTime").try_cast("timestamp").cast("date"),
            "lat": backfill_coordinate(F.col("InitialLatitude"), F.col("y")),
            "lon": backfill_coordinate(F.col("InitialLongitude"), F.col("x")),
        }
    ).na.drop(subset=["date", "lat", "lon"])
    points = points.where(valid_coordinate(F.col("lon"), F.col("lat")) & F.col("date").between(start, end))
    if state and "POOState" in df.columns:
        points = points.where(F.col("POOState") == state)
    points = within_polygon(points, boundary) if boundary is not None else points.where(in_bbox(F.col("lon"), F.col("lat"), bbox))
    named = "IrwinID" in df.columns
    out = points.select("date", "lat", "lon", *([F.col("IrwinID").alias("incident_id")] if named else []))
    if named:
        out = keep_first(out, ["incident_id"], ["date", "lat", "lon"])
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("lat", "lon")})


def clean_detections(df: DataFrame, bbox: Sequence[float], keep: Sequence[str] = ("n", "h"), boundary: DataFrame | None = None) -> DataFrame:
    """Satellite detections -> (date, lat, lon, confidence score), one per day and rounded position."""
    named = resolve_columns(df, {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "date": ("date", "acq_date")})
    code = F.lower(F.col("confidence").cast("string"))
    rows = named.where(code.isin(list(keep))).withColumn("date", F.col("date").try_cast("timestamp").cast("date"))
    rows = rows.na.drop(subset=["date", "lat", "lon"])
    rows = rows.where(in_bbox(F.col("lon"), F.col("lat"), bbox))
    if boundary is not None:
        rows = within_polygon(rows, boundary)
    rounded = rows.select(
        "date", half_even(F.col("lat").cast("double"), 6).alias("lat"), half_even(F.col("lon").cast("double"), 6).alias("lon"), confidence_score(code).alias("confidence")
    )
    return keep_first(rounded, ["date", "lat", "lon"], ["confidence"])


def dedupe_events(df: DataFrame) -> DataFrame:
    """One event per (incident, day), or per (position, day) where incidents carry no id."""
    keys = ["incident_id", "date"] if "incident_id" in df.columns else ["lat", "lon", "date"]
    return keep_first(df, keys, [c for c in ("lat", "lon") if c not in keys])
