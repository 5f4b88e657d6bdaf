"""Same-day features of neighbouring cells.

A row travels to every tile that holds a cell linked to it: once per tile, not once
per edge, and takes along which cells those are.  There it counts for each of them.
The grouping keys contain the tile and day the rows were sent by, so the aggregate
needs no second exchange, and the links are looked up by the cell the panel is
already laid out by, whether they are broadcast or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.spatial import bucket_of, bucket_text
from terrapanel.session import cut_lineage, fits_broadcast

LEVELS = range(2, 21)
TILE_CELLS = 20_000  # cells the fullest tile is meant to hold
RADIUS_TILE_CELLS = 500  # the same for means over a radius, where a tile with all its days is one task's


def tile_level(cells: DataFrame, most: int = TILE_CELLS) -> int:
    """The coarsest bucket level whose fullest tile holds no more than ``most`` cells."""
    keys = ", ".join(f"struct({lv} as level, {bucket_text('lat', 'lon', lv)} as key)" for lv in LEVELS)
    counts = cells.select(F.expr(f"explode(array({keys}))").alias("b")).groupBy("b.level", "b.key").agg(F.count("*").alias("n"))
    fullest = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.max("n").alias("n")).collect()}  # one row per level
    return next((lv for lv in LEVELS if fullest.get(lv, 0) <= most), LEVELS[-1])


def _around(panel: DataFrame, cells: DataFrame, links: DataFrame, made: dict, cell: str, date: str) -> DataFrame:
    """Aggregates over linked rows of the same day, one output row per panel row.

    ``links``: (cell, neighbor_id, _own, _linked); the ``_own`` link brings the row's own
    columns, ``_linked`` ones count for the aggregates.  The links of a cell into one
    tile are one array, as long as its neighbours are many.
    """
    tiles = cells.select(F.col(cell), bucket_of("lat", "lon", tile_level(cells)).alias("_tile"))
    flags = [c for c in links.columns if c not in (cell, "neighbor_id")]
    placed = links.join(tiles, cell).groupBy("neighbor_id", "_tile").agg(F.collect_list(F.struct(cell, *flags)).alias("_to"))
    routes = cut_lineage(placed)
    # Eight bytes a field, and the letters of ids that are text; read off the arrays.
    letters = F.aggregate("_to", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t[cell].cast("string"))) if dict(cells.dtypes)[cell] == "string" else F.lit(0)
    size = routes.agg(F.coalesce(F.sum(F.size("_to") * (24 + 8 * len(flags)) + letters + 32), F.lit(0)).cast("long")).first()[0]
    kept = [c for c in panel.columns if c not in (cell, date)]
    routed = panel.withColumnRenamed(cell, "neighbor_id").join(F.broadcast(routes) if fits_broadcast(1, size) else routes.hint("shuffle_hash"), "neighbor_id")
    sent = routed.repartition("_tile", date).select("*", F.inline("_to")).drop("_to", "neighbor_id")
    own = F.any_value(F.when(F.col("_own"), F.struct(*kept)), F.lit(True)).alias("_self")
    summed = sent.groupBy("_tile", date, cell).agg(own, *[a.alias(n) for n, a in made.items()])
    return summed.where(F.col("_self").isNotNull()).select(cell, date, "_self.*", *made)


def neighbor_sum(
    panel: DataFrame, cells: DataFrame, edges: DataFrame, columns: Sequence[str], *, cell: str = "grid_id", date: str = "date", prefix: str = "neighbor_"
) -> DataFrame:
    """Adds per column the total over the linked cells on the same day; a neighbour without a row counts 0."""
    others = edges.where(F.col(cell) != F.col("neighbor_id")).select(cell, "neighbor_id", F.lit(False).alias("_own"), F.lit(True).alias("_linked"))
    own = cells.select(cell, F.col(cell).alias("neighbor_id"), F.lit(True).alias("_own"), F.lit(False).alias("_linked"))
    made = {f"{prefix}{c}": F.coalesce(F.sum(F.when(F.col("_linked"), F.col(c))), F.lit(0)) for c in columns}
    return _around(panel, cells, others.unionByName(own), made, cell, date)


def radius_mean(
    panel: DataFrame, cells: DataFrame, edges: DataFrame, columns: dict[str, str], *, cell: str = "grid_id", date: str = "date"
) -> DataFrame:
    """Adds per column (``{column: output}``) the NULL-skipping mean over all cells within the radius, itself included.

    Links are many here, so they don't ride along with every row: a cell's days are one
    array, as long as the calendar, which meets the cell's links into a tile once.  Only
    sums are kept per cell and day; the row's own columns come back by a join.
    """
    tiles = cells.select(F.col(cell), bucket_of("lat", "lon", tile_level(cells, RADIUS_TILE_CELLS)).alias("_tile"))
    tiles = F.broadcast(tiles) if fits_broadcast(1, _id_bytes(cells, cell, 32)) else tiles
    routes = edges.select(cell, "neighbor_id").join(tiles, cell).groupBy("neighbor_id", "_tile").agg(F.collect_list(cell).alias("_to"))
    known = panel.where(F.col(cell).isNotNull())
    days = known.groupBy(F.col(cell).alias("neighbor_id")).agg(F.collect_list(F.struct(date, *columns)).alias("_days"))
    sent = routes.join(days, "neighbor_id").repartition("_tile").select("_tile", "neighbor_id", "_to", F.inline("_days"))
    sent = sent.select("_tile", "neighbor_id", date, *columns, F.explode("_to").alias(cell)).withColumn("_own", F.col(cell) == F.col("neighbor_id"))
    means = sent.groupBy("_tile", date, cell).agg(F.max("_own").alias("_own"), *[F.avg(c).alias(out) for c, out in columns.items()]).where("_own")
    means = means.select(F.col(cell).alias("_cell"), F.col(date).alias("_date"), *columns.values())
    kept = [c for c in panel.columns if c not in (cell, date)]
    own = known.groupBy(cell, date).agg(F.any_value(F.struct(*kept)).alias("_self"))
    joined = own.join(means, (F.col(cell) == F.col("_cell")) & F.col(date).eqNullSafe(F.col("_date")))
    return joined.select(cell, date, "_self.*", *columns.values())


def _id_bytes(cells: DataFrame, cell: str, row_bytes: int) -> int:
    """Bytes of a table with one id a row."""
    size = F.coalesce(F.octet_length(F.col(cell).cast("string")), F.lit(0)) + row_bytes
    return cells.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
