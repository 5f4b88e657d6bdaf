"""Boundaries: edge tables, containment, and exact clipping of square cells.

Boundary tables hold rings as rows: ``ring_id``, ``hole`` and ``ring``, an array of
(x, y) structs whose last vertex repeats the first.  Ground is inside if more outer
rings than holes lie around it, so parts may overlap, touch or enclose each other, and
rings may run either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.columns import bound
from terrapanel.functions.geo import albers_forward_text
from terrapanel.session import fits_broadcast
from terrapanel.operators.spatial import salted

RINGS_SCHEMA = "ring_id long, hole boolean, ring array<struct<x: double, y: double>>"


def bbox_polygon(spark: SparkSession, bbox: Sequence[float]) -> DataFrame:
    """Boundary of (lon_min, lat_min, lon_max, lat_max); stands in where no boundary file exists."""
    x0, y0, x1, y1 = (float(v) for v in bbox)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return spark.createDataFrame([(0, False, corners)], RINGS_SCHEMA)


def project_rings(rings: DataFrame, crs: str = "EPSG:3310") -> DataFrame:
    x, y = albers_forward_text("v.x", "v.y", crs)
    return rings.withColumn("ring", F.expr(f"transform(ring, v -> named_struct('x', {x}, 'y', {y}))"))


def oriented(rings: DataFrame) -> DataFrame:
    """Outer rings counter-clockwise, holes clockwise, so that every edge has its ground to the left."""
    first = F.element_at("ring", 1)

    def cross(i: Column) -> Column:
        a, b = F.element_at("ring", i), F.element_at("ring", i + 1)
        return (a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"])

    area = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, i: s + cross(i))
    return rings.withColumn("ring", F.when((area > 0) == F.coalesce("hole", F.lit(False)), F.reverse("ring")).otherwise(F.col("ring")))


def edges_of(rings: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2) per ring edge."""
    numbered = rings.where(F.size("ring") > 1).select("ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("i"))
    a, b = F.element_at("ring", F.col("i")), F.element_at("ring", F.col("i") + 1)
    return numbered.select(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def band_count(edges: int, tall: float, height: float) -> tuple[int, int]:
    """How many horizontal bands, and a bound of the edge copies they hold.

    An edge is copied to every band it reaches; edges ``tall`` together make as many
    copies as their height in bands plus two each, kept below a fixed multiple of
    the edges.
    """
    bands = max(1, min(edges // 4, int(4 * edges * height / tall)))
    return bands, 2 * edges + math.ceil(bands * tall / height)


def within_polygon(points: DataFrame, rings: DataFrame, *, x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows inside the boundary by its winding number (half-open: lower and left edges count as inside).

    Edges are grouped by horizontal band, so a point meets only the edges of its band;
    rows are neither copied nor shuffled while the band table can be broadcast.
    """
    edges = edges_of(oriented(rings.where(F.size("ring") > 1))).where("y1 <> y2")
    size = edges.agg(
        F.count("*").alias("n"), F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2")), F.sum(F.abs(F.col("y2") - F.col("y1")))
    ).first()
    n, x0, y0, x1, y1, tall = size
    if not n:
        return points.where(F.lit(False))
    bands, copies = band_count(n, tall, y1 - y0)
    height = (y1 - y0) / bands

    def band(v: Column) -> Column:
        return F.least(F.floor((v - y0) / height), F.lit(bands - 1)).cast("int")

    span = F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))
    banded = edges.withColumn("_band", span).groupBy("_band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    px, py = F.col(x), F.col(y)
    near = points.where(px.between(x0, x1) & py.between(y0, y1)).withColumn("_band", band(py))
    if fits_broadcast(copies, 40):
        joined = near.join(F.broadcast(banded), "_band")
    else:
        left, right = salted(near, banded, F.struct(px, py))
        joined = left.join(right, ["_band", "_salt"]).drop("_salt")

    def crossed(e: Column) -> Column:
        reaches = (e["y1"] > py) != (e["y2"] > py)
        return reaches & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    # Looking east, edges that go up have their ground on this side, edges that go down beyond.
    covers = F.aggregate(F.filter("_edges", crossed), F.lit(0), lambda n, e: n + F.when(e["y2"] > e["y1"], 1).otherwise(-1))
    return joined.where(covers > 0).drop("_band", "_edges")


def clip_ring(ring: Column, x_range: tuple[Column, Column] | None = None, y_range: tuple[Column, Column] | None = None) -> Column:
    """Part of a closed ring inside a coordinate range, closed again; NULL when nothing is left.

    Every bound is a half-plane ``a x + b y >= c``; the ring passes through them one
    after the other (Sutherland-Hodgman), edge by edge inside the array.
    """

    def plane(a: float, b: float, c: Column) -> Column:
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c"))

    planes = []
    if x_range:
        planes += [plane(1.0, 0.0, x_range[0]), plane(-1.0, 0.0, -x_range[1])]
    if y_range:
        planes += [plane(0.0, 1.0, y_range[0]), plane(0.0, -1.0, -y_range[1])]

    def cut(kept: Column, side: Column) -> Column:
        def depth(v: Column) -> Column:
            return side["a"] * v["x"] + side["b"] * v["y"] - side["c"]

        def step(v: Column, i: Column) -> Column:
            w = F.try_element_at(kept, i + 2)
            share = depth(v) / (depth(v) - depth(w))
            border = F.struct((v["x"] + share * (w["x"] - v["x"])).alias("x"), (v["y"] + share * (w["y"] - v["y"])).alias("y"))
            nothing = F.array().cast("array<struct<x: double, y: double>>")
            return (
                F.when(w.isNull(), nothing)
                .when((depth(v) >= 0) & (depth(w) >= 0), F.array(w))
                .when(depth(v) >= 0, F.array(border))
                .when(depth(w) >= 0, F.array(border, w))
                .otherwise(nothing)
            )

        return bound(F.flatten(F.transform(kept, step)), lambda inside: F.concat(inside, F.slice(inside, 1, 1)))

    clipped = F.aggregate(F.array(*planes), ring.cast("array<struct<x: double, y: double>>"), cut)
    return F.get(F.filter(F.array(clipped), lambda r: F.size(r) >= 4), F.lit(0))


def ring_moments(ring: Column) -> Column:
    """(area, mx, my): unsigned area and first moments of a closed ring by the shoelace sums.

    Sums run relative to the first vertex, which keeps them accurate far from the origin.
    """
    def moments(ring: Column) -> Column:
        def about(first: Column) -> Column:
            def term(i: Column) -> Column:
                ends = F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b"))
                return bound(ends, lambda e: crossed(*[e[v][c] - first[c] for v in "ab" for c in "xy"]))

            def crossed(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
                sides = F.struct((ax * by - bx * ay).alias("c"), (ax + bx).alias("x"), (ay + by).alias("y"))
                return bound(sides, lambda s: F.struct(s["c"].alias("c"), (s["c"] * s["x"]).alias("mx"), (s["c"] * s["y"]).alias("my")))

            zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
            return F.aggregate(
                F.transform(F.sequence(F.lit(1), F.size(ring) - 1), term),
                zero,
                lambda s, t: F.struct((s["c"] + t["c"]).alias("c"), (s["mx"] + t["mx"]).alias("mx"), (s["my"] + t["my"]).alias("my")),
                lambda s: F.struct(
                    (F.abs(s["c"]) / 2).alias("area"),
                    (F.sign(s["c"]) * s["mx"] / 6 + F.abs(s["c"]) / 2 * first["x"]).alias("mx"),
                    (F.sign(s["c"]) * s["my"] / 6 + F.abs(s["c"]) / 2 * first["y"]).alias("my"),
                ),
            )

        return bound(F.element_at(ring, 1), about)

    # Bound once: a ring that is itself worked out would be so again for every vertex.
    return bound(ring, moments)
