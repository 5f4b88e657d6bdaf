"""Column builders for cleaning and feature engineering."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Detection confidence scores.
CONFIDENCE_SCORE = {"l": 33, "n": 66, "h": 90}

# Detection confidence names.
CONFIDENCE_LEVEL = {"l": 0, "low": 0, "n": 1, "nominal": 1, "h": 2, "high": 2}

# Upper edges of the numeric confidence bins; the lowest edge is -1, exclusive.
CONFIDENCE_EDGES = (-1.0, 49.999, 79.999, 1e9)

# Land-cover class names.
LAND_COVER_CLASSES = {
    11: "Open Water",
    12: "Perennial Ice/Snow",
    21: "Developed, Open Space",
    22: "Developed, Low Intensity",
    23: "Developed, Medium Intensity",
    24: "Developed, High Intensity",
    31: "Barren Land (Rock/Sand/Clay)",
    41: "Deciduous Forest",
    42: "Evergreen Forest",
    43: "Mixed Forest",
    52: "Shrub/Scrub",
    71: "Grassland/Herbaceous",
    81: "Pasture/Hay",
    82: "Cultivated Crops",
    90: "Woody Wetlands",
    95: "Emergent Herbaceous Wetlands",
}


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_number(col: Column) -> Column:
    """Numeric value, NULL where the text is no number or is NaN."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def strip_units(col: Column) -> Column:
    """Drop unit words and thousands commas, then coerce.

    Letters go wherever they stand, so a scientific ``1e-05`` loses its ``e`` and
    becomes NULL; callers rely on that.
    """
    bare = F.regexp_replace(F.regexp_replace(col.cast("string"), "[A-Za-z_ ]+", ""), ",", "")
    return to_number(bare)


def backfill_coordinate(primary: Column, secondary: Column) -> Column:
    """The primary coordinate unless it is missing or zero."""
    first = to_number(primary)
    return F.coalesce(F.when(first != 0, first), to_number(secondary))


def in_season(date: Column, year: int | None, months: tuple[int, int]) -> Column:
    """Days of the given months, both inclusive, of one year or of every year."""
    test = F.month(date).between(*months)
    return test if year is None else test & (F.year(date) == year)


def half_even(col: Column, digits: int) -> Column:
    """Round half to even; negative digits snap to tens, hundreds, ..."""
    if digits < 0:
        unit = float(10 ** (-digits))
        return F.rint(col / unit) * unit
    return F.bround(col, digits)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def in_bbox(lon: Column, lat: Column, bbox: Sequence[float]) -> Column:
    """Inclusive test against (lon_min, lat_min, lon_max, lat_max)."""
    return lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def right_closed_bin(col: Column, edges: Sequence[float]) -> Column:
    """0-based index of the bin ``(edges[i], edges[i+1]]``; NULL outside all bins."""
    out = None
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        hit = (col > low) & (col <= high)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def confidence_score(col: Column) -> Column:
    return literal_map(CONFIDENCE_SCORE)[F.lower(col.cast("string"))]


def normalise_confidence(col: Column) -> Column:
    """0/1/2 from a confidence name or a numeric confidence; 0 when neither reads."""
    text = F.lower(col.cast("string"))
    return F.coalesce(literal_map(CONFIDENCE_LEVEL)[text], right_closed_bin(to_number(text), CONFIDENCE_EDGES), F.lit(0))


def epoch_ms_to_local_text(col: Column, tz: str = "America/Los_Angeles") -> Column:
    """Epoch milliseconds -> local wall clock such as ``7/1/2023 5:00:00 PM``."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(col.cast("long")), tz), "M/d/yyyy h:mm:ss a")


def day_of_year_to_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), doy.cast("int") - 1)


def local_window_utc(start: str, end: str, tz: str = "America/Los_Angeles") -> tuple[Column, Column]:
    """UTC bounds of the local days ``start`` .. ``end``, both inclusive."""
    low = F.to_utc_timestamp(F.lit(f"{start} 00:00:00").cast("timestamp"), tz)
    high = F.to_utc_timestamp(F.lit(f"{end} 23:59:59").cast("timestamp"), tz)
    return low, high


def slope_degrees(p: Column, q: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(p * p + q * q)))


def aspect_degrees(p: Column, q: Column) -> Column:
    """Compass aspect, 0 = north, clockwise; NULL on flat ground."""
    angle = F.degrees(F.atan2(p, -q))
    turned = F.when(angle < 0, angle + 360.0).otherwise(angle)
    return F.when(~((p == 0) & (q == 0)), turned)


def with_interactions(df: DataFrame) -> DataFrame:
    """Dryness, heat and fuel products of the weather and vegetation columns."""
    t, rh, w, ndvi = (F.col(c) for c in ("T2M", "RH2M", "WS10M", "ndvi"))
    return df.withColumns(
        {
            "vpd_proxy": (F.lit(1.0) - rh / 100.0) * t,
            "hot_windy": t * w,
            "dry_windy": (F.lit(100.0) - rh) * w,
            "fuel_moisture_proxy": ndvi * rh,
        }
    )


def with_seasonal(df: DataFrame, date: str = "date") -> DataFrame:
    """Day-of-year (period 366) and month (period 12) on the unit circle."""
    day = F.dayofyear(date) * (2 * math.pi) / 366.0
    month = F.month(date) * (2 * math.pi) / 12.0
    return df.withColumns(
        {
            "day_of_year": F.dayofyear(date),
            "month": F.month(date),
            "day_sin": F.sin(day),
            "day_cos": F.cos(day),
            "month_sin": F.sin(month),
            "month_cos": F.cos(month),
        }
    )


def class_column_names(prefix: str = "pct_") -> dict[str, str]:
    """``pct_11 -> pct_Open_Water`` and so on: blanks and slashes become underscores, commas go."""
    spelled = str.maketrans({" ": "_", "/": "_", ",": None})
    return {f"{prefix}{code}": prefix + name.translate(spelled) for code, name in LAND_COVER_CLASSES.items()}
