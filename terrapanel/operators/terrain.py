"""Slope and aspect from scattered elevation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.columns import aspect_degrees, half_even, slope_degrees
from terrapanel.functions.geo import albers_forward


def gradient(samples: DataFrame, line: str, along: str, x: str, z: str, out: str) -> DataFrame:
    """dz/dx on every ``line``: central where both neighbours exist, else one-sided.

    A neighbour is the next existing sample.  Lines hold one row per raster cell, so a
    window partition is bounded by the extent divided by the cell size.
    """
    order = Window.partitionBy(line).orderBy(along)

    def difference(a: int, b: int):
        def at(c: str, k: int):
            return F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order) if k < 0 else F.col(c)

        return F.try_divide(at(z, b) - at(z, a), at(x, b) - at(x, a))

    return samples.withColumn(out, F.coalesce(difference(-1, 1), difference(0, 1), difference(-1, 0)))


def snapped_terrain(samples: DataFrame) -> DataFrame:
    """(xr, yr, slope_deg, aspect_deg) from rows (xr, yr, x, y, z); samples of one cell are averaged."""
    cells = samples.groupBy("xr", "yr").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])
    sloped = gradient(gradient(cells, "yr", "xr", "x", "z", "p"), "xr", "yr", "y", "z", "q")
    return sloped.select(
        "xr", "yr", slope_degrees(F.col("p"), F.col("q")).alias("slope_deg"), aspect_degrees(F.col("p"), F.col("q")).alias("aspect_deg")
    )


def terrain(df: DataFrame, *, lon: str = "longitude", lat: str = "latitude", elev: str = "elev", crs: str = "EPSG:5070", digits: int = -3) -> DataFrame:
    """Adds slope_deg and aspect_deg; rows lacking coordinates or elevation stay, without values."""
    x, y = albers_forward(lon, lat, crs)
    known = F.col(elev).isNotNull()
    rows = df.withColumns({"_x": F.when(known, x), "_y": F.when(known, y)})
    rows = rows.withColumns({"xr": half_even(F.col("_x"), digits), "yr": half_even(F.col("_y"), digits)})
    usable = rows.where(F.col("xr").isNotNull() & F.col("yr").isNotNull())
    cells = snapped_terrain(usable.select("xr", "yr", F.col("_x").alias("x"), F.col("_y").alias("y"), F.col(elev).alias("z")))
    return rows.join(cells, ["xr", "yr"], "left").drop("xr", "yr", "_x", "_y")
