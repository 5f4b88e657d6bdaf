"""Exact nearest-cell, k-nearest and radius joins on the sphere.

Cells are put into dyadic latitude/longitude buckets.  A row first looks at the
cells around its own bucket (one equi-join, no shuffle of the rows while the cell
side is broadcast).  Rows whose answer that cannot prove go down a tree of bounding
circles, level by level, each step an equi-join on the parent bucket.  No step
pairs everything with everything and nothing is cut off: the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.geo import EARTH_RADIUS_KM, haversine_km, haversine_km_text, num
from terrapanel.session import cut_lineage, fits_broadcast

MIN_LEVEL, MAX_LEVEL = 2, 24
MAX_ROOTS = 64  # buckets at the top of the tree
LEAF_ROWS = 32  # the tree goes down until its fullest bucket holds no more
SALTS = 8


_SHIFT = 1 << 32


def bucket_xy(lat: str, lon: str, level: int) -> tuple[str, str]:
    """SQL text of a bucket's column and row."""
    scale = num(2.0**level / 360.0)
    return f"pmod(cast(floor(({lon} + 180D) * {scale}) as bigint), {2**level}L)", f"cast(floor(({lat} + 90D) * {scale}) as bigint)"


def bucket_text(lat: str, lon: str, level: int) -> str:
    ix, iy = bucket_xy(lat, lon, level)
    return f"({ix} * {_SHIFT}L + {iy})"


def bucket_of(lat: str, lon: str, level: int) -> Column:
    return F.expr(bucket_text(lat, lon, level))


def _bucket_centre(key: str, level: int) -> tuple[str, str]:
    """SQL text of the latitude and longitude of a bucket's centre."""
    size, ix = num(360.0 / 2.0**level), f"floor({key} / {num(_SHIFT)})"
    return f"(({key} - {ix} * {_SHIFT}L + 0.5D) * {size} - 90D)", f"(({ix} + 0.5D) * {size} - 180D)"


def salted(left: DataFrame, right: DataFrame, salt_on: Column, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Spread every key of ``left`` over ``salts`` values of ``_salt`` and copy ``right`` to each."""
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")),
        right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
    )


def _key_join(left: DataFrame, right: DataFrame, right_rows: int, row_bytes: int, keys: list[str], how: str, salt_on: Column) -> DataFrame:
    """Equi-join that broadcasts a small right side, by counted rows and their bytes, and salts the left otherwise."""
    if fits_broadcast(right_rows, row_bytes):
        return left.join(F.broadcast(right), keys, how)
    left, right = salted(left, right, salt_on)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


@dataclass
class CellIndex:
    """Positions of a cell dimension plus the bucket statistics that size the joins."""

    cells: DataFrame  # _cell, _clat, _clon
    rows: int
    levels: dict[int, tuple[int, int]]  # level -> (occupied buckets, fullest bucket)
    id_bytes: int = 8  # of the longest id

    def near_level(self, k: int) -> int:
        """Bucket level of the neighbourhood lookup: the coarsest whose fullest bucket stays small."""
        fitting = [lv for lv, (_, fullest) in sorted(self.levels.items()) if fullest <= max(4, 2 * k)]
        return max(4, fitting[0]) if fitting else MAX_LEVEL

    @property
    def tree_levels(self) -> list[int]:
        roots = [lv for lv, (occupied, _) in self.levels.items() if occupied <= MAX_ROOTS]
        level, out = max(roots, default=MIN_LEVEL), []
        while True:
            out.append(level)
            if self.levels[level][1] <= LEAF_ROWS or level + 2 > MAX_LEVEL:
                return out
            level += 2

    def nodes(self, i: int) -> DataFrame:
        """Tree level ``i``: buckets with their parent, size, centre and the reach of their farthest cell."""
        levels = self.tree_levels
        parent = bucket_of("_clat", "_clon", levels[i - 1]) if i else F.lit(0)
        keyed = self.cells.select(bucket_of("_clat", "_clon", levels[i]).alias("_node"), parent.alias("_parent"), "_clat", "_clon")
        lat, lon = _bucket_centre("_node", levels[i])
        reach = F.expr(f"max({haversine_km_text(lat, lon, '_clat', '_clon')}) * {num(1 + 1e-9)} + 1e-6D")
        grouped = keyed.groupBy("_node", "_parent").agg(F.count("*").alias("_n"), reach.alias("_reach"))
        return grouped.select("*", F.expr(lat).alias("_nlat"), F.expr(lon).alias("_nlon"))

    @cached_property
    def roots(self) -> list:
        """The top of the tree: at most MAX_ROOTS rows."""
        return self.nodes(0).collect()


def index_cells(cells: DataFrame, cell_id: str = "grid_id", lat: str = "lat", lon: str = "lon", *, by_position: bool = True) -> CellIndex:
    """Measure a cell dimension; with ``by_position`` the lowest id stands for all cells at one position.

    The distinct cells are written once: every join below reads them several times.
    """
    located = cells.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(cell_id).alias("_cell"), F.col(lat).cast("double").alias("_clat"), F.col(lon).cast("double").alias("_clon")
    )
    if by_position:
        located = located.groupBy("_clat", "_clon").agg(F.min("_cell").alias("_cell")).select("_cell", "_clat", "_clon")
    else:
        located = located.distinct()
    located = cut_lineage(located)
    keys = ", ".join(f"struct({lv} as level, {bucket_text('_clat', '_clon', lv)} as key)" for lv in range(MIN_LEVEL, MAX_LEVEL + 1))
    counts = located.select(F.expr(f"explode(array({keys}))").alias("b")).groupBy("b.level", "b.key").agg(F.count("*").alias("n"))
    stats = counts.groupBy("level").agg(F.count("*").alias("occupied"), F.max("n").alias("fullest"), F.sum("n").alias("rows"))
    found = stats.collect()  # one row per level
    if not found:
        raise ValueError("the cell dimension is empty")
    longest = located.agg(F.max(F.octet_length(F.col("_cell").cast("string")))).first()[0]
    return CellIndex(located, found[0]["rows"], {r["level"]: (r["occupied"], r["fullest"]) for r in found}, max(8, longest))


def _neighbourhoods(index: CellIndex, level: int) -> DataFrame:
    """bucket -> cells of the bucket and its eight neighbours (array of bounded length)."""
    ix, iy = bucket_xy("_clat", "_clon", level)
    keys = ", ".join(f"pmod({ix} + {dx}, {2**level}L) * {_SHIFT}L + {iy} + {dy}" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
    around = F.expr(f"explode(array({keys}))")
    return (
        index.cells.select(around.alias("_bucket"), F.struct("_cell", "_clat", "_clon", *_unit_vector("_clat", "_clon")).alias("c"))
        .groupBy("_bucket")
        .agg(F.collect_list("c").alias("_around"))
    )


def _unit_vector(lat: str, lon: str) -> list[Column]:
    """x, y, z of a position on the unit sphere."""
    parts = {"x": f"cos(radians({lat})) * cos(radians({lon}))", "y": f"cos(radians({lat})) * sin(radians({lon}))", "z": f"sin(radians({lat}))"}
    return [F.expr(text).alias(axis) for axis, text in parts.items()]


def _safe_chord_text(lat: str, level: int) -> str:
    """Squared chord within which no cell outside the 3x3 buckets can lie (less a rounding margin)."""
    step = f"radians({num(360.0 / 2.0**level)})"
    half = f"sin(least({step}, asin(cos(radians({lat})) * sin({step}))) / 2)"
    return f"({num(4 * (1 - 1e-9))} * {half} * {half})"


def _tree_nearest(coords: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """k nearest cells of distinct positions (_lat, _lon) -> _found: array of (dist_km, cell), best first."""
    levels = index.tree_levels

    def prune(frontier: DataFrame) -> DataFrame:
        point = "partition by _lat, _lon"
        measured = frontier.withColumn("_d", haversine_km("_lat", "_lon", "_nlat", "_nlon"))
        measured = measured.withColumn("_members", F.expr(f"sum(_n) over ({point} order by _d + _reach, _node rows unbounded preceding)"))
        measured = measured.withColumn("_bound", F.expr(f"min(case when _members >= {k} then _d + _reach end) over ({point})"))
        return measured.where("_bound is null or _d - _reach <= _bound").select("_lat", "_lon", F.col("_node").alias("_parent"))

    listed = ", ".join(
        f"named_struct('_node', {r['_node']}L, '_n', {r['_n']}L, '_reach', {num(r['_reach'])}, '_nlat', {num(r['_nlat'])}, '_nlon', {num(r['_nlon'])})" for r in index.roots
    )
    frontier = prune(coords.select("_lat", "_lon", F.expr(f"inline(array({listed}))")))
    spread = F.struct("_lat", "_lon")
    for i in range(1, len(levels)):
        frontier = prune(_key_join(frontier, index.nodes(i), index.levels[levels[i]][0], 64, ["_parent"], "inner", spread))
    leaves = index.cells.withColumn("_parent", bucket_of("_clat", "_clon", levels[-1]))
    pairs = _key_join(frontier, leaves, index.rows, 40 + index.id_bytes, ["_parent"], "inner", spread)
    found = pairs.select("_lat", "_lon", F.expr(_ranked_cell("_cell", "_clat", "_clon")).alias("_hit"))
    if k == 1:
        return found.groupBy("_lat", "_lon").agg(F.array(F.min("_hit")).alias("_found"))
    order = Window.partitionBy("_lat", "_lon").orderBy("_hit")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return best.groupBy("_lat", "_lon").agg(F.sort_array(F.collect_list("_hit")).alias("_found"))


def _ranked_cell(cell: str, clat: str, clon: str) -> str:
    """Sorts by distance, equal to a micrometre, then by id; the distance itself rides along."""
    km = haversine_km_text("_lat", "_lon", clat, clon)
    return f"named_struct('rank_km', round({km}, 9), 'cell', {cell}, 'dist_km', {km})"


def _nearest(points: DataFrame, index: CellIndex, k: int, lat: str, lon: str) -> DataFrame:
    """Adds ``_found``; rows without coordinates get NULL."""
    level = index.near_level(k)
    near = _neighbourhoods(index, level)
    rows = points.select("*", F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    rows = rows.withColumn("_bucket", bucket_of("_lat", "_lon", level))
    # At most nine copies of every cell, each with five numbers and its id.
    looked = _key_join(rows, near, 9 * index.rows, 56 + index.id_bytes, ["_bucket"], "left", F.struct("_lat", "_lon"))
    looked = looked.select("*", F.struct(*_unit_vector("_lat", "_lon")).alias("_at"))
    # Squared chords find the k-th best and shortlist the candidates, distances proper rank the shortlist.
    # The generator keeps Spark from computing the k-th best again for every use.
    chord = " + ".join(f"(c.{axis} - _at.{axis}) * (c.{axis} - _at.{axis})" for axis in "xyz")
    chords = f"transform(_around, c -> {chord})"
    limit = f"array_min({chords})" if k == 1 else f"try_element_at(array_sort({chords}), {k})"
    looked = looked.select("*", F.expr(f"inline(array(named_struct('_limit', {limit})))"))
    proven = f"(_lat is null or _lon is null or coalesce(_limit <= {_safe_chord_text('_lat', level)}, false))"
    short = f"filter(_around, c -> {chord} <= _limit * 1.000001D + 1e-14D)"
    scored = f"transform({short}, c -> {_ranked_cell('c._cell', 'c._clat', 'c._clon')})"
    best = f"array(array_min({scored}))" if k == 1 else f"slice(array_sort({scored}), 1, {k})"
    # The places the neighbourhood can't prove are usually few: they are settled first, as a
    # table of their own, and the rows then pass once, whether proven or not.
    doubtful = cut_lineage(looked.where(f"not {proven}").select("_lat", "_lon").distinct())
    count = doubtful.count()
    if not count:
        return looked.select(*points.columns, F.expr(best).alias("_found"))
    answers = cut_lineage(_tree_nearest(doubtful, index, k).withColumnRenamed("_found", "_answer"))
    flagged = looked.select(*points.columns, "_lat", "_lon", F.expr(f"case when {proven} then {best} end").alias("_near"))
    joined = _key_join(flagged, answers, count, 16 + k * (40 + index.id_bytes), ["_lat", "_lon"], "left", F.monotonically_increasing_id())
    return joined.select(*points.columns, F.coalesce("_near", "_answer").alias("_found"))


def assign_nearest(
    points: DataFrame,
    cells: DataFrame | CellIndex,
    *,
    lat: str = "lat",
    lon: str = "lon",
    cell_id: str = "grid_id",
    cell_lat: str = "lat",
    cell_lon: str = "lon",
) -> DataFrame:
    """Each row gets its nearest cell (no distance cap) and the distance in km; ties go to the lowest id.

    Pass an index made by ``index_cells`` to share its measurements between several sources.
    """
    index = cells if isinstance(cells, CellIndex) else index_cells(cells, cell_id, cell_lat, cell_lon)
    best = F.col("_found")[0]
    return _nearest(points, index, 1, lat, lon).withColumns({cell_id: best["cell"], "dist_km": best["dist_km"]}).drop("_found")


def knn_edges(cells: DataFrame, k: int = 8, *, cell_id: str = "grid_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(cell, neighbour, dist_km, rank): the k nearest other cells of every cell."""
    every = cells.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(cell_id).alias("_cell"), F.col(lat).cast("double").alias("_clat"), F.col(lon).cast("double").alias("_clon")).distinct()
    # Of the cells at one place only the k + 1 lowest ids can be anybody's neighbours.
    here = Window.partitionBy("_clat", "_clon").orderBy("_cell")
    lowest = every.withColumn("_at", F.row_number().over(here)).where(F.col("_at") <= k + 1).drop("_at")
    index = index_cells(lowest, "_cell", "_clat", "_clon", by_position=False)
    found = _nearest(every, index, k + 1, "_clat", "_clon")
    others = F.filter("_found", lambda h: h["cell"] != F.col("_cell"))
    ranked = found.select("_cell", F.posexplode(F.slice(others, 1, k)).alias("_pos", "_hit"))
    return ranked.select(
        F.col("_cell").alias(cell_id), F.col("_hit.cell").alias("neighbor_id"), F.col("_hit.dist_km").alias("dist_km"), (F.col("_pos") + 1).alias("rank")
    )


def radius_edges(cells: DataFrame, radius_km: float, *, cell_id: str = "grid_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(cell, neighbour, dist_km) for all cells within ``radius_km``, the cell itself included."""
    angle = radius_km / EARTH_RADIUS_KM
    level = MIN_LEVEL
    while level < MAX_LEVEL and 360.0 / 2 ** (level + 1) >= angle * 57.29577951308232 * 1.0001:
        level += 1
    size = 360.0 / 2.0**level
    here = cells.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(cell_id), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")
    )
    r, width, whole = num(angle * (1 + 1e-9)), num(size), 2**level
    # Meridians that touch the circle; a circle over a pole touches all of them.
    spread = f"degrees(asin(least(1D, sin({r}) / cos(radians(_lat)))))"
    west, east = (f"cast(floor((_lon {sign} {spread} + 180D) / {width}) as bigint)" for sign in "-+")
    everything = f"abs(radians(_lat)) + {r} >= 1.5707963D or {east} - {west} >= {whole - 1}"
    south, north = (f"cast(floor((_lat {sign} degrees({r}) + 90D) / {width}) as bigint)" for sign in "-+")
    reached = here.withColumn("_ix", F.expr(f"explode(case when {everything} then sequence(0L, {whole - 1}L) else sequence({west}, {east}) end)"))
    reached = reached.withColumn("_iy", F.expr(f"explode(sequence({south}, {north}))"))
    reached = reached.withColumn("_bucket", F.expr(f"pmod(_ix, {whole}L) * {_SHIFT}L + _iy")).drop("_ix", "_iy")
    there = here.select(
        F.col(cell_id).alias("neighbor_id"), F.col("_lat").alias("_nlat"), F.col("_lon").alias("_nlon"), bucket_of("_lat", "_lon", level).alias("_bucket")
    )
    # A cell table is one small file; the pairs are many more than its cells, and all cores shall make them.
    reached = reached.repartition(4 * max(1, cells.sparkSession.sparkContext.defaultParallelism), F.col(cell_id))
    left, right = salted(reached, there, F.col(cell_id))
    pairs = left.join(right, ["_bucket", "_salt"])
    distance = haversine_km("_lat", "_lon", "_nlat", "_nlon")
    return pairs.withColumn("dist_km", distance).where(F.col("dist_km") <= radius_km).select(cell_id, "neighbor_id", "dist_km")

