"""Boundary files (GeoJSON) as ring tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators.polygons import bbox_polygon

_POINTS = "array<array<double>>"
_GEOMETRY = "struct<type: string, coordinates: string>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, geometry type, coordinates text) per feature of a GeoJSON file."""
    schema = f"type string, features array<struct<properties: map<string,string>, geometry: {_GEOMETRY}>>"
    document = spark.read.schema(schema).json(path, multiLine=True)
    return document.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def dissolve(found: DataFrame, wanted: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rings of the features whose properties match the first satisfiable (name, value) pair.

    Parts stay separate rings, also where they overlap or touch: what lies inside is a
    matter of winding numbers, and ``grid`` unites what meets in a cell.
    """
    if wanted:
        tests = [F.col("properties")[name] == value for name, value in wanted]
        rank = F.coalesce(*[F.when(t, i) for i, t in enumerate(tests)])
        ranked = found.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
        found = ranked.where(F.col("_rank") == ranked.agg(F.min("_rank")).scalar()).drop("_rank")
    polygons = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<array<{_POINTS}>>")).when(
        F.col("type") == "Polygon", F.array(F.from_json("coordinates", f"array<{_POINTS}>"))
    )
    parts = found.select(F.explode(polygons).alias("polygon")).select(F.posexplode("polygon").alias("n", "points"))
    ring = F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return parts.select(F.monotonically_increasing_id().alias("ring_id"), (F.col("n") > 0).alias("hole"), ring.alias("ring"))


def read_boundary(spark: SparkSession, path: str | None, wanted: Sequence[tuple[str, str]] = (), bbox: Sequence[float] | None = None) -> DataFrame:
    """Rings of a boundary file in degrees; the box stands in when there is no file."""
    if path and _exists(spark, path):
        return dissolve(features(spark, path), wanted)
    if bbox is None:
        raise FileNotFoundError(path)
    return bbox_polygon(spark, bbox)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
