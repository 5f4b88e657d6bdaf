"""Vegetation tiles and class rasters as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import in_bbox

# Attributes that may hold the acquisition time, best first.
DATE_ATTRIBUTES = ("time_coverage_start", "RangeBeginningDate")


def file_date(attrs: Column, file: Column) -> Column:
    """Acquisition day from the attributes, else from ``_YYYYMMDD_`` in the file name, else NULL."""
    stated = [F.try_to_date(F.substring(attrs[a], 1, 10), "yyyy-MM-dd") for a in DATE_ATTRIBUTES]
    return F.coalesce(*stated, F.try_to_date(F.regexp_extract(file, r"_(\d{8})_", 1), "yyyyMMdd"))


def _number(attrs: Column, name: str) -> Column:
    return attrs[name].try_cast("double")


def parsed_attributes(attrs: Column) -> Column:
    """The numbers that decoding needs, as one struct: parse them once a tile."""
    bounds = F.split(F.regexp_replace(attrs["valid_range"], r"[\[\]\s]", ""), ",")
    ends = [F.when(F.size(bounds) == 2, F.try_element_at(bounds, F.lit(i)).try_cast("double")) for i in (1, 2)]
    numbers = {
        "low": F.greatest(ends[0], _number(attrs, "valid_min")), "high": F.least(ends[1], _number(attrs, "valid_max")),
        "fill": _number(attrs, "_FillValue"), "missing": _number(attrs, "missing_value"),
        "scale": F.coalesce(_number(attrs, "scale_factor"), F.lit(1.0)), "offset": F.coalesce(_number(attrs, "add_offset"), F.lit(0.0)),
    }
    return F.struct(*[c.alias(n) for n, c in numbers.items()])


def decode_raw(raw: Column, numbers: Column) -> Column:
    """Stored code -> physical value by scale and offset; codes outside the stated range or equal to a fill are NULL.

    A test whose attribute is absent does not reject.
    """
    tests = [raw < numbers["low"], raw > numbers["high"], raw == numbers["fill"], raw == numbers["missing"]]
    bad = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        bad = bad | F.coalesce(test, F.lit(False))
    return F.when(~bad, raw * numbers["scale"] + numbers["offset"])


def mask_fill(col: Column, floor: float = -0.9) -> Column:
    """NULL for scaled fill values, infinities and NaN."""
    return F.when((col > floor) & (F.abs(col) < float("inf")) & ~F.isnan(col), col)


def window_lines(tiles: DataFrame, bbox: Sequence[float] | None = None) -> DataFrame:
    """(date, numbers, latitude, lons, line): what a window takes of tiles ``file, attrs, lat[], lon[], raw[]`` (raw is row-major), line by line.

    The axes say which lines and which stretch of each lie inside, whichever way they
    run; nothing else of a tile leaves its row.  Tiles without any are dropped.
    """

    def within(axis: str, low: float | None, high: float | None) -> Column:
        places = F.when(F.size(axis) > 0, F.sequence(F.lit(1), F.size(axis))).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: F.element_at(axis, i).between(low, high)) if bbox else places

    x0, y0, x1, y1 = bbox or (None,) * 4
    width = F.size("lon")
    # Everything about a tile is worked out before its lines are taken apart.
    found = tiles.select(file_date(F.col("attrs"), F.col("file")).alias("date"), parsed_attributes(F.col("attrs")).alias("numbers"), "lat", "lon", "raw", within("lat", y0, y1).alias("_rows"), within("lon", x0, x1).alias("_cols"))
    first = F.array_min("_cols")
    count = F.array_max("_cols") - first + 1

    def line(i: Column) -> Column:
        return F.struct(F.element_at("lat", i).alias("latitude"), F.slice("raw", (i - 1) * width + first, count).alias("line"))

    held = found.where((F.size("_rows") > 0) & (F.size("_cols") > 0)).select("date", "numbers", F.slice("lon", first, count).alias("lons"), F.transform("_rows", line).alias("_lines"))
    return held.select("date", "numbers", "lons", F.inline("_lines"))


def tiles_to_rows(tiles: DataFrame, *, bbox: Sequence[float] | None = None, out: str = "ndvi") -> DataFrame:
    """(date, longitude, latitude, value) rows of tiles ``file, attrs, lat[], lon[], raw[]`` (raw is row-major).

    Only lines and stretches inside ``bbox`` become rows; where an axis turns back, its
    rows are tested once more.
    """
    lines = window_lines(tiles, bbox)
    pixels = lines.select("date", "numbers", "latitude", F.inline(F.zip_with("lons", "line", lambda x, v: F.struct(x.alias("longitude"), v.alias("_raw")))))
    rows = pixels.select("date", "longitude", "latitude", decode_raw(F.col("_raw").cast("double"), F.col("numbers")).alias(out))
    return rows.where(in_bbox(F.col("longitude"), F.col("latitude"), bbox)) if bbox else rows


def window_read(pixels: DataFrame, bounds: Sequence[float], *, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels of a class raster inside projected bounds; plain range tests, so row groups are skipped by min/max."""
    return pixels.where(F.col(x).between(bounds[0], bounds[2]) & F.col(y).between(bounds[1], bounds[3]))


def clip_pixels(pixels: DataFrame, rings: DataFrame, *, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Pixels whose centre lies inside a boundary; each distinct centre is tested once, however many days it has."""
    from terrapanel.operators.polygons import within_polygon

    inside = within_polygon(pixels.select(lon, lat).distinct(), rings, x=lon, y=lat)
    return pixels.join(inside, [lon, lat], "left_semi")
