"""Land-cover composition of raster cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.columns import bound
from terrapanel.operators.polygons import clip_ring, ring_moments


def landcover_fraction(
    pixels: DataFrame, cell: Sequence[str], code: str, classes: Sequence, *, renormalise: bool = False, prefix: str = "pct_"
) -> DataFrame:
    """Percent of the pixels of each cell in each class; cells without any classified pixel are dropped.

    Shares are of all pixels of the cell, or of the classified ones with ``renormalise``.
    One map-side combined aggregate serves all classes.
    """
    hits = [F.count_if(F.col(code) == F.lit(c)) for c in classes]
    counted = pixels.groupBy(*cell).agg(
        F.count("*").alias("_all"), F.count_if(F.col(code).isin(list(classes))).alias("_valid"), *[h.alias(f"{prefix}{c}") for h, c in zip(hits, classes)]
    )
    base = F.col("_valid") if renormalise else F.col("_all")
    shares = [(F.col(f"{prefix}{c}") * 100.0 / base).alias(f"{prefix}{c}") for c in classes]
    return counted.where("_valid > 0").select(*cell, *shares)


def square_footprint(x: Column, y: Column, size: float) -> Column:
    """Closed ring of a square pixel around its centre."""
    half = size / 2
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])


def spread_over_cells(pixels: DataFrame, cell_m: float, *, ring: str = "ring", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Every pixel once for each square it covers ground of: its columns without ``ring``, and i, j, ``covered`` (m2) and ``share`` of the pixel.

    ``ring`` is the pixel's projected footprint, any convex ring; the squares are those its
    own bounds reach, so a pixel is copied to the few it covers, before any shuffle.  A
    pixel inside one square is not clipped.  Shares of a pixel sum to one; pixels
    without a footprint or without ground are left out.
    """
    kept = [c for c in pixels.columns if c != ring]

    def reach(axis: str, low: float) -> Column:
        values = F.transform(ring, lambda v: v[axis])
        return F.sequence(F.floor((F.array_min(values) - low) / cell_m), F.floor((F.array_max(values) - low) / cell_m))

    # Exploded, a value is worked out once; a filter on a mere expression would repeat it.
    rings = pixels.select(*kept, F.explode(F.array(F.col(ring))).alias(ring)).where(F.size(ring) > 3)
    measures = F.struct(F.array(reach("x", x0), reach("y", y0)).alias("_reach"), ring_moments(F.col(ring))["area"].alias("_whole"))
    placed = rings.select(*kept, ring, F.inline(F.array(measures)))
    alone = (F.size(F.col("_reach")[0]) == 1) & (F.size(F.col("_reach")[1]) == 1)
    spread = placed.where("_whole > 0").withColumn("_alone", alone).withColumn("i", F.explode(F.col("_reach")[0])).withColumn("j", F.explode(F.col("_reach")[1]))

    def side(index: str, low: float) -> tuple[Column, Column]:
        start = F.lit(float(low)) + F.col(index) * float(cell_m)
        return start, start + float(cell_m)

    cut = bound(clip_ring(F.col(ring), side("i", x0), side("j", y0)), lambda r: ring_moments(r)["area"])
    covered = F.when(F.col("_alone"), F.col("_whole")).otherwise(cut)
    return spread.select(*kept, "i", "j", "_whole", F.explode(F.array(covered)).alias("covered")).where("covered > 0").select(*kept, "i", "j", "covered", (F.col("covered") / F.col("_whole")).alias("share"))


def landcover_area_fraction(covered: DataFrame, code: str, classes: Sequence, *, renormalise: bool = False, prefix: str = "pct_") -> DataFrame:
    """(i, j, shares): percent of each square's covered ground in each class, from ``spread_over_cells``.

    Pixels count by the ground they cover in the square, not by where their centres
    are.  Shares are of all covered ground, or of the classified with ``renormalise``;
    squares without any classified ground are dropped.
    """
    ground = F.col("covered")
    known = F.sum(F.when(F.col(code).isin(list(classes)), ground))
    summed = covered.groupBy("i", "j").agg(F.sum(ground).alias("_all"), known.alias("_valid"), *[F.sum(F.when(F.col(code) == F.lit(c), ground)).alias(f"{prefix}{c}") for c in classes])
    base = F.col("_valid") if renormalise else F.col("_all")
    return summed.where("_valid > 0").select("i", "j", *[(F.coalesce(f"{prefix}{c}", F.lit(0.0)) * 100.0 / base).alias(f"{prefix}{c}") for c in classes])
