"""Means over a radius without pairs: tiles that lie wholly inside count as one.

Tiles of a quadtree are compared with each other, not cells.  If all cells of one lie
within the radius of all cells of another, one link between the tiles stands for all
their pairs; if none do, there is none; only what is in doubt goes down to the tiles
below, and from small tiles to single cells, whose distances are exact.  So a place
with many cells costs what its tiles cost: cells at one place are one tile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.geo import haversine_km, haversine_km_text
from terrapanel.operators.neighbors import radius_mean
from terrapanel.operators.spatial import MAX_LEVEL, MIN_LEVEL, bucket_of, radius_edges
from terrapanel.session import cut_lineage, fits_broadcast

# Pairs of cells up to which two tiles are taken apart, and levels gone down at a time.
CELL_PAIRS, STEP = 64, 2
_MARGIN_KM = 1e-6
_LEVEL = 1 << 57


@dataclass
class RadiusLinks:
    """Who lies within the radius of whom, cells themselves included: every pair is in one of two tables."""

    cells: DataFrame  # all cells: id, lat, lon
    near: DataFrame  # id, neighbor_id: single pairs
    tiles: DataFrame  # node, other: every cell of ``other`` for every cell of ``node``
    members: DataFrame  # node, id: the cells of the nodes that ``tiles`` names
    tile_links: int


def _nodes(located: DataFrame, level: int) -> DataFrame:
    """Tiles of a level: node, parent (``STEP`` levels up), how many cells, the middle of their bounds and its reach."""
    keyed = located.select(bucket_of("_lat", "_lon", level).alias("node"), bucket_of("_lat", "_lon", max(level - STEP, 0)).alias("parent"), "_lat", "_lon")
    bounds = [f(c).alias(f"{n}{c}") for c in ("_lat", "_lon") for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = keyed.groupBy("node", "parent").agg(F.count("*").alias("n"), *bounds)
    boxes = boxes.withColumns({"lat": (F.col("lo_lat") + F.col("hi_lat")) / 2, "lon": (F.col("lo_lon") + F.col("hi_lon")) / 2})
    corners = F.greatest(haversine_km("lat", "lon", "lo_lat", "lo_lon"), haversine_km("lat", "lon", "hi_lat", "lo_lon"))
    return boxes.select("node", "parent", "n", "lat", "lon", (corners * (1 + 1e-9) + _MARGIN_KM).alias("reach"))


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{c}_{name}") for c in ("node", "parent", "n", "lat", "lon", "reach")])


def _first_level(radius_km: float) -> int:
    """The coarsest level whose tiles are no taller than the radius."""
    level = MIN_LEVEL
    while level < MAX_LEVEL and 360.0 / 2**level * 111.2 > radius_km:
        level += 1
    return level


def radius_links(cells: DataFrame, radius_km: float, *, cell_id: str = "grid_id", lat: str = "lat", lon: str = "lon") -> RadiusLinks:
    """Compare tiles, from those as tall as the radius downwards; cells without coordinates have no links."""
    known = cells.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    located = cut_lineage(known.select(F.col(cell_id), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).distinct())
    level = _first_level(radius_km)
    top = cut_lineage(_nodes(located, level))
    reach = top.agg(F.max("reach")).first()[0] or 0.0
    pairs = radius_edges(top, radius_km + 2 * reach, cell_id="node").select(F.col("node").alias("node_a"), F.col("neighbor_id").alias("node_b"))
    frontier = pairs.join(_side(top, "a"), "node_a").join(_side(top, "b"), "node_b")
    whole, single = [], []
    while True:
        gap = haversine_km_text("lat_a", "lon_a", "lat_b", "lon_b")
        frontier = cut_lineage(frontier.withColumn("d", F.expr(gap)).where(F.col("d") - F.col("reach_a") - F.col("reach_b") <= radius_km + _MARGIN_KM))
        inside = F.col("d") + F.col("reach_a") + F.col("reach_b") <= radius_km - _MARGIN_KM
        last = level + STEP > MAX_LEVEL
        small = F.lit(last) & ~inside | (F.col("n_a") * F.col("n_b") <= CELL_PAIRS)
        whole.append((level, frontier.where(inside & ~small).select("node_a", "node_b")))
        single.append((level, frontier.where(small).select("node_a", "node_b")))
        doubt = frontier.where(~inside & ~small)
        if last or doubt.isEmpty():
            break
        level += STEP
        below = cut_lineage(_nodes(located, level))
        doubt = doubt.select(F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"))
        frontier = doubt.join(_side(below, "a"), "parent_a").join(_side(below, "b"), "parent_b")

    def within(at: int, found: DataFrame) -> DataFrame:
        here = located.select(bucket_of("_lat", "_lon", at).alias("node_a"), cell_id, "_lat", "_lon")
        there = located.select(bucket_of("_lat", "_lon", at).alias("node_b"), F.col(cell_id).alias("neighbor_id"), F.col("_lat").alias("_nlat"), F.col("_lon").alias("_nlon"))
        joined = found.join(here, "node_a").join(there, "node_b").where(haversine_km("_lat", "_lon", "_nlat", "_nlon") <= radius_km)
        return joined.select(cell_id, "neighbor_id")

    near = _union([within(at, found) for at, found in single])
    tiles = cut_lineage(_union([found.select((F.col("node_a") + at * _LEVEL).alias("node"), (F.col("node_b") + at * _LEVEL).alias("other")) for at, found in whole]))
    used = tiles.select(F.explode(F.array("node", "other")).alias("node")).distinct()
    placed = _union([located.select((bucket_of("_lat", "_lon", at) + at * _LEVEL).alias("node"), cell_id) for at, _ in whole])
    links = tiles.count()
    members = cut_lineage(placed.join(used, "node")) if links else placed.limit(0)
    return RadiusLinks(located.select(cell_id, F.col("_lat").alias("lat"), F.col("_lon").alias("lon")), cut_lineage(near), tiles, members, links)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def radius_mean_by_tiles(panel: DataFrame, links: RadiusLinks, columns: dict[str, str], *, cell: str = "grid_id", date: str = "date") -> DataFrame:
    """Adds per column (``{column: output}``) the NULL-skipping mean over the same day's rows of all cells within the radius, its own included.

    ``panel`` has one row per cell and day.  A tile's rows are added up once, its total
    goes to the tiles it is linked to, and from there to the rows of their cells, not to
    every cell on every day; single pairs are added as they are.  Cells without links get NULL.
    """
    if not links.tile_links:
        return radius_mean(panel, links.cells, links.near, columns, cell=cell, date=date)
    totals = [f"_{kind}{n}" for n in range(len(columns)) for kind in "sc"]

    def added(first: bool) -> list[Column]:
        if first:
            return [agg.alias(f"_{kind}{n}") for n, c in enumerate(columns) for kind, agg in (("s", F.sum(F.col(c).cast("double"))), ("c", F.count(c)))]
        return [F.sum(t).alias(t) for t in totals]

    def by(table: DataFrame, key: str, bytes_of_row: int) -> DataFrame:
        return F.broadcast(table) if fits_broadcast(table.count(), bytes_of_row) else table

    values = panel.select(cell, date, *columns)
    single = values.withColumnRenamed(cell, "neighbor_id").join(by(links.near, "neighbor_id", 48), "neighbor_id").groupBy(cell, date).agg(*added(True))
    members = by(links.members, cell, 48)
    of_tile = values.join(members, cell).groupBy(F.col("node").alias("other"), date).agg(*added(True))
    to_tile = cut_lineage(of_tile.join(by(links.tiles, "other", 32), "other").groupBy("node", date).agg(*added(False)))
    asking = panel.select(cell, date).distinct().join(members, cell)
    from_tiles = asking.join(by(to_tile, "node", 32 + 16 * len(columns)), ["node", date]).select(cell, date, *totals)
    whole = single.unionByName(from_tiles).groupBy(cell, date).agg(*added(False))
    means = {out: F.try_divide(F.col(f"_s{n}"), F.col(f"_c{n}").cast("double")) for n, out in enumerate(columns.values())}
    return panel.join(whole, [cell, date], "left").withColumns(means).drop(*totals)
