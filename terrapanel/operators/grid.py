"""Regular grids in projected metres: bounds, centroids, clipped cells, raster frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapanel.functions.columns import bound
from terrapanel.functions.geo import albers_forward, albers_inverse, albers_inverse_text
from terrapanel.operators.outlines import PARTS_SCHEMA, cells_to_parts
from terrapanel.operators.polygons import clip_ring, ring_moments, within_polygon
from terrapanel.session import cut_lineage


def extent(df: DataFrame, x: str, y: str) -> tuple[float, float, float, float]:
    """(x_min, y_min, x_max, y_max) of two columns: one aggregate, one row to the driver."""
    row = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return row[0], row[1], row[2], row[3]


def projected_bounds(spark: SparkSession, bbox: Sequence[float], crs: str, edge_points: int = 0) -> tuple[float, float, float, float]:
    """Bounds of a lon/lat box after projection; ``edge_points`` extra points along every side."""
    x0, y0, x1, y1 = (float(v) for v in bbox)
    steps = edge_points + 1
    along = F.expr(f"{x0!r}D + id / {steps}D * {x1 - x0!r}D"), F.expr(f"{y0!r}D + id / {steps}D * {y1 - y0!r}D")
    low, high = (F.lit(x0), F.lit(y0)), (F.lit(x1), F.lit(y1))
    ends = [(along[0], low[1]), (along[0], high[1]), (low[0], along[1]), (high[0], along[1])]
    sides = spark.range(steps + 1).select(F.explode(F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ends])).alias("p"))
    x, y = albers_forward("p.lon", "p.lat", crs)
    return extent(sides.select(x.alias("x"), y.alias("y")), "x", "y")


def _steps(low: float, high: float, size: float) -> int:
    """How many values low, low+size, ... lie below high."""
    return max(0, math.ceil((high - low) / size))


def centroid_grid(spark: SparkSession, bbox: Sequence[float], cell_m: float = 5000.0, crs: str = "EPSG:3310") -> DataFrame:
    """Cell centres over a lon/lat box, numbered from 1 row by row (south to north, west to east)."""
    x0, y0, x1, y1 = projected_bounds(spark, bbox, crs)
    half = cell_m / 2
    nx, ny = _steps(x0 + half, x1, cell_m), _steps(y0 + half, y1, cell_m)
    centres = spark.range(nx * ny).selectExpr(
        "id + 1 as grid_id", f"{x0 + half!r}D + id % {nx} * {float(cell_m)!r}D as x", f"{y0 + half!r}D + id div {nx} * {float(cell_m)!r}D as y"
    )
    lon, lat = albers_inverse("x", "y", crs)
    return centres.select("grid_id", lat.alias("centroid_lat"), lon.alias("centroid_lon"))


def cell_of(x: Column, y: Column, x0: float, y0: float, cell_m: float) -> tuple[Column, Column]:
    """Column and row of the square that holds a projected point; shared edges go to the upper cell."""
    return F.floor((x - x0) / cell_m), F.floor((y - y0) / cell_m)


def assign_to_cells(
    points: DataFrame, cells: DataFrame, rings: DataFrame, cell_m: float = 5000.0, crs: str = "EPSG:3310", *, lon: str = "lon", lat: str = "lat", whole_metres: bool = False
) -> DataFrame:
    """Points inside a projected boundary with the id of the clipped cell they fall into.

    ``cells`` comes from ``number_cells`` or ``cell_grid`` over the same boundary.  The cell
    follows from arithmetic and an equi-join on (i, j); no geometry is compared pair by pair.
    """
    x0, y0, _, _ = extent(rings.select(F.explode("ring").alias("v")).select("v.x", "v.y"), "x", "y")
    x0, y0 = (float(int(v)) if whole_metres else v for v in (x0, y0))
    x, y = albers_forward(lon, lat, crs)
    inside = within_polygon(points.withColumns({"_x": x, "_y": y}), rings, x="_x", y="_y")
    i, j = cell_of(F.col("_x"), F.col("_y"), x0, y0, cell_m)
    return inside.withColumns({"i": i, "j": j}).drop("_x", "_y").join(cells.select("i", "j", "grid_id"), ["i", "j"])


def _ring_pieces(rings: DataFrame, cell_m: float, whole_metres: bool) -> tuple[DataFrame, int]:
    """(i, j, hole, ring): what each square over a projected boundary holds of each ring; and the squares of a column.

    Rings are first cut into vertical strips, then strips into cells, so a cell only
    works on the vertices of its strip.
    """
    corner = rings.select(F.explode("ring").alias("v")).select("v.x", "v.y")
    x0, y0, x1, y1 = extent(corner, "x", "y")
    if whole_metres:
        # Integer origins and an integer upper end, exclusive after one more step.
        x0, y0, x1, y1 = int(x0), int(y0), int(x1), int(y1)
    nx, ny = _steps(x0, x1, cell_m), _steps(y0, y1, cell_m)
    x0, y0 = float(x0), float(y0)

    def range_of(index: str, low: float) -> tuple[Column, Column]:
        start = F.lit(low) + F.col(index) * cell_m
        return start, start + cell_m

    # Each ring meets the strips it reaches, and no others.
    first, last = (F.floor((pick(F.transform("ring", lambda v: v["x"])) - x0) / cell_m) for pick in (F.array_min, F.array_max))
    reached = F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(nx - 1).cast("long")))
    strips = rings.where(first <= last).where((last >= 0) & (first <= nx - 1)).select(F.explode(reached).alias("i"), F.coalesce("hole", F.lit(False)).alias("hole"), "ring")
    strips = strips.withColumn("ring", clip_ring(F.col("ring"), x_range=range_of("i", x0)))
    reach = F.aggregate(
        "ring",
        F.struct(F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high")),
        lambda s, v: F.struct(F.least(s["low"], v["y"]).alias("low"), F.greatest(s["high"], v["y"]).alias("high")),
        lambda s: F.sequence(F.floor((s["low"] - y0) / cell_m), F.floor((s["high"] - y0) / cell_m)),
    )
    cells = strips.withColumn("j", F.explode(reach)).where(F.col("j").between(0, ny - 1))
    return cells.select("i", "j", "hole", clip_ring(F.col("ring"), y_range=range_of("j", y0)).alias("ring")), ny


def _parts(pieces: DataFrame) -> DataFrame:
    """(i, j, part, rings, area, mx, my): the disjoint parts of each cell, overlaps united.  The pieces of one cell meet in one row."""
    held = pieces.where("ring is not null").groupBy("i", "j").agg(F.collect_list(F.struct("hole", "ring")).alias("pieces"))
    return held.mapInArrow(cells_to_parts, PARTS_SCHEMA)


def clipped_cells(rings: DataFrame, cell_m: float = 5000.0, *, whole_metres: bool = False) -> DataFrame:
    """Squares over a projected boundary cut to it: (i, j, cell, area, cx, cy), empty ones left out.

    ``whole_metres`` starts the grid at the integer part of the bounds.  Where pieces of
    several outer rings meet in a cell, they are united first, so that ground they
    share counts once; everywhere else the rings' own sums do.
    """
    pieces, ny = _ring_pieces(rings, cell_m, whole_metres)
    several = rings.where(~F.coalesce("hole", F.lit(False))).count() > 1
    pieces = cut_lineage(pieces) if several else pieces
    signed = pieces.select("i", "j", "hole", F.when(F.col("hole"), -1.0).otherwise(1.0).alias("s"), bound(F.col("ring"), ring_moments).alias("m"))
    sums = {"area": "area", "mx": "mx", "my": "my"}
    merged = signed.groupBy("i", "j").agg(*[F.sum(F.col("s") * F.col(f"m.{m}")).alias(n) for n, m in sums.items()], F.count_if(~F.col("hole") & (F.col("m.area") > 0)).alias("outers"))
    if several:
        crowded = merged.where("outers > 1").select("i", "j")
        united = _parts(pieces.join(crowded, ["i", "j"], "left_semi")).groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in sums])
        merged = merged.where("outers <= 1").drop("outers").unionByName(united)
    # Slivers below a square millimetre are rounding, not land.
    kept = merged.where(F.col("area") > 1e-6)
    return kept.select(
        "i", "j", (F.col("i") * ny + F.col("j")).alias("cell"), "area", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy")
    )


def cell_polygons(rings: DataFrame, cell_m: float = 5000.0, *, whole_metres: bool = False) -> DataFrame:
    """What a projected boundary leaves of each square, as polygons: (i, j, cell, part, rings, area, cx, cy), one row per part.

    ``rings`` holds the part's outer ring, counter-clockwise, and its holes, clockwise,
    each closed and from its least corner on.  Overlapping pieces are one part, pieces
    that touch in a corner are several.
    """
    pieces, ny = _ring_pieces(rings, cell_m, whole_metres)
    parts = _parts(pieces)
    return parts.select(
        "i", "j", (F.col("i") * ny + F.col("j")).alias("cell"), "part", "rings", "area", (F.col("mx") / F.col("area")).alias("cx"), (F.col("my") / F.col("area")).alias("cy")
    )


def number_cells(cells: DataFrame, scheme: str = "text", prefix: str = "CA5K_") -> DataFrame:
    """Adds ``grid_id``: ``text`` = dense zero-padded ids column by column, ``integer`` = the square's own number.

    Dense numbers come from per-column totals, so no task orders the whole grid.
    """
    if scheme == "integer":
        return cells.withColumn("grid_id", F.col("cell"))
    cells = cut_lineage(cells)  # read twice
    per_column = cells.groupBy("i").agg(F.count("*").alias("_n"))  # one row per grid column
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_column.select("i", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    numbered = cells.join(F.broadcast(offsets), "i").withColumn("_rank", rank)
    return numbered.withColumn("grid_id", F.format_string(f"{prefix}%05d", F.col("_rank"))).drop("_before", "_rank")


def cell_grid(rings: DataFrame, cell_m: float = 5000.0, crs: str = "EPSG:3310", scheme: str = "text") -> DataFrame:
    """Lookup (grid_id, lon, lat) of cells clipped to a projected boundary, at the clipped centroid."""
    cells = number_cells(clipped_cells(rings, cell_m, whole_metres=scheme == "integer"), scheme)
    lon, lat = albers_inverse("cx", "cy", crs)
    return cells.select("grid_id", lon.alias("lon"), lat.alias("lat"), "i", "j", "area")


def grid_geometry(rings: DataFrame, cell_m: float = 5000.0, crs: str = "EPSG:3310", scheme: str = "text") -> DataFrame:
    """(grid_id, lon, lat, parts): the clipped cells, their centroids, and their outlines in degrees; ``parts`` holds polygons of rings.

    The clipped squares are made once; ids, centroids and outlines all follow from their parts.
    """
    polygons = cut_lineage(cell_polygons(rings, cell_m, whole_metres=scheme == "integer"))
    weighted = [F.sum(F.col(c) * F.col("area")).alias(f"_{c}") for c in ("cx", "cy")]
    merged = polygons.groupBy("i", "j", "cell").agg(F.sum("area").alias("area"), *weighted, F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("parts"))
    merged = merged.where(F.col("area") > 1e-6).withColumns({c: F.col(f"_{c}") / F.col("area") for c in ("cx", "cy")})
    lon, lat = albers_inverse("cx", "cy", crs)
    x, y = albers_inverse_text("v.x", "v.y", crs)
    outlines = F.expr(f"transform(parts, p -> transform(p.rings, r -> transform(r, v -> named_struct('x', {x}, 'y', {y}))))")
    return number_cells(merged, scheme).select("grid_id", lon.alias("lon"), lat.alias("lat"), outlines.alias("parts"))


def raster_frame(spark: SparkSession, bbox: Sequence[float], res_m: float = 1000.0, crs: str = "EPSG:5070") -> DataFrame:
    """Pixels of a north-up raster over a lon/lat box: (row, col, x, y, longitude, latitude) of pixel centres."""
    x0, y0, x1, y1 = projected_bounds(spark, bbox, crs, edge_points=21)
    width, height = math.ceil((x1 - x0) / res_m), math.ceil((y1 - y0) / res_m)
    res = f"{float(res_m)!r}D"
    pixels = spark.range(width * height).selectExpr(f"id div {width} as row", f"id % {width} as col")
    pixels = pixels.selectExpr("row", "col", f"{x0!r}D + (col + 0.5D) * {res} as x", f"{y1!r}D - (row + 0.5D) * {res} as y")
    lon, lat = albers_inverse("x", "y", crs)
    return pixels.select("*", lon.alias("longitude"), lat.alias("latitude"))
