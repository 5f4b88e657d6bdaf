"""Spatial joins, grids, projections, terrain and raster queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrapanel.functions.columns import clip
from terrapanel.functions.geo import albers_forward, albers_inverse
from terrapanel.operators.grid import assign_to_cells, cell_grid as clipped_lookup, cell_of, cell_polygons, centroid_grid, clipped_cells, extent, grid_geometry, number_cells, raster_frame
from terrapanel.operators.landcover import landcover_area_fraction, landcover_fraction, spread_over_cells, square_footprint
from terrapanel.operators.neighbors import neighbor_sum, radius_mean
from terrapanel.operators.panel import build_panel, cell_day_mean, densify, merge_factors
from terrapanel.operators.polygons import RINGS_SCHEMA, within_polygon
from terrapanel.operators.radius import radius_links, radius_mean_by_tiles
from terrapanel.operators.spatial import assign_nearest, index_cells, knn_edges, radius_edges
from terrapanel.operators.terrain import terrain
from terrapanel.operators.timeseries import densify_cube, event_history, fill_cube, fill_time
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.roles import place, place_sql, table
from terrapanel.session import cut_lineage, ensure_checkpoint_dir
from terrapanel.sources.sinks import write_grid
from terrapanel.sources.tiles import clip_pixels, mask_fill, tiles_to_rows


@register(
    "nearest_cell",
    "id:l lat:f9 lon:f9 grid_id:l dist_km:f6",
    f"with {roles.CELLS}, {roles.POINTS}, {roles.nearest_sql('points', 'id', 'near')} select * from near",
)
def nearest_cell(spark, sf_dir):
    return assign_nearest(roles.points(spark, sf_dir), roles.cells(spark, sf_dir))


@register(
    "reverse_nearest",
    "id:l grid_id:l dist_km:f6",
    f"""with {roles.CELLS}, sites as (select distinct user_id as grid_id, {place_sql('user_id')} from events), targets as (select grid_id as id, lat, lon from cells),
    {roles.nearest_sql('targets', 'id', 'near', 'sites')} select * from near""",
)
def reverse_nearest(spark, sf_dir):
    """Every cell gets its nearest weather site, so no cell stays empty."""
    sites = table(spark, sf_dir, "events").select(F.col("user_id").alias("grid_id"), *[c.alias(n) for n, c in place("user_id").items()]).distinct()
    return assign_nearest(roles.cells(spark, sf_dir).withColumnRenamed("grid_id", "id"), sites)


_PAIRS = f"pairs as (select a.grid_id, b.grid_id as neighbor_id, {roles.haversine_sql('a', 'b')} as dist_km from cells a cross join cells b)"
_KNN = """knn as (select * from (select *, row_number() over (partition by grid_id order by round(dist_km, 9), neighbor_id) as rank from pairs where grid_id <> neighbor_id)
  where rank <= 8)"""


@register("knn_cells", "grid_id:l neighbor_id:l rank:l dist_km:f6", f"with {roles.CELLS}, {_PAIRS}, {_KNN} select * from knn")
def knn_cells(spark, sf_dir):
    return knn_edges(roles.cells(spark, sf_dir), 8)


@register("radius_pairs", "grid_id:l neighbor_id:l dist_km:f6", f"with {roles.CELLS}, {_PAIRS} select * from pairs where dist_km <= 10")
def radius_pairs(spark, sf_dir):
    return radius_edges(roles.cells(spark, sf_dir), 10.0)


def _inside_sql(source: str, x: str, y: str) -> str:
    return f"""select * from {source} p where (select count(*) from edges e where (e.y1 > p.{y}) <> (e.y2 > p.{y})
      and p.{x} < (e.x2 - e.x1) * (p.{y} - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1"""


@register("point_in_polygon", "id:l lat:f9 lon:f9", f"with {roles.POINTS}, {roles.outline_edges_sql()} {_inside_sql('points', 'lon', 'lat')}")
def point_in_polygon(spark, sf_dir):
    return within_polygon(roles.points(spark, sf_dir), roles.outline(spark))


@register(
    "raster_polygon_clip",
    "vec_id:l pixel:l value:f6",
    f"""with {roles.outline_edges_sql()}, px as (select vec_id, unnest(generate_series(0, len(embedding) - 1)) as pixel, unnest(embedding) as value from embeddings),
    spots as (select *, -124.6e0 + pixel * 0.023e0 as lon, 32.45e0 + (vec_id % 1000) * 0.0041e0 as lat from px) {_inside_sql('spots', 'lon', 'lat')}""",
)
def raster_polygon_clip(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pixel", "value"))
    placed = pixels.withColumns(
        {"longitude": F.lit(-124.6) + F.col("pixel") * F.lit(0.023), "latitude": F.lit(32.45) + F.col("vec_id") % 1000 * F.lit(0.0041)}
    )
    return clip_pixels(placed, roles.outline(spark))


_XY = f"with {roles.POINTS}, {roles.cone_sql('EPSG:3310')}, xy as ({roles.forward_sql('points')})"


def _projected_points(spark, sf_dir):
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    return roles.points(spark, sf_dir).withColumns({"x": x, "y": y})


@register(
    "point_in_cell",
    "id:l i:l j:l",
    f"{_XY} select id, floor((x - (select min(x) from xy)) / 5000) as i, floor((y - (select min(y) from xy)) / 5000) as j from xy",
)
def point_in_cell(spark, sf_dir):
    """Cell of every point in a 5 km grid that starts at the points' own corner."""
    points = _projected_points(spark, sf_dir)
    x0, y0, _, _ = extent(points, "x", "y")
    i, j = cell_of(F.col("x"), F.col("y"), x0, y0, 5000.0)
    return points.select("id", i.alias("i"), j.alias("j"))


def _cells_box(spark, sf_dir):
    """The cells' projected extent with a margin."""
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    x0, y0, x1, y1 = extent(roles.cells(spark, sf_dir).select(x.alias("x"), y.alias("y")), "x", "y")
    return x0 - 7000.0, y0 - 7000.0, x1 + 7000.0, y1 + 7000.0


def _framed_boundary(spark, sf_dir):
    """The cells' projected extent with a rectangular hole in it."""
    x0, y0, x1, y1 = _cells_box(spark, sf_dir)

    def box(a, b, c, d):
        return [(a, b), (c, b), (c, d), (a, d), (a, b)]

    w, h = x1 - x0, y1 - y0
    hole = box(x0 + 0.31 * w, y0 + 0.17 * h, x0 + 0.72 * w, y0 + 0.64 * h)
    return spark.createDataFrame([(0, False, box(x0, y0, x1, y1)), (1, True, hole)], RINGS_SCHEMA)


_CLIPPED = f"""with {roles.CELLS}, {roles.cone_sql('EPSG:3310')}, xy as ({roles.forward_sql('cells')}),
box as (select *, x1 - x0 as w, y1 - y0 as h from (select min(x) - 7000 as x0, min(y) - 7000 as y0, max(x) + 7000 as x1, max(y) + 7000 as y1 from xy)),
hole as (select x0 + 0.31e0 * w as hx0, y0 + 0.17e0 * h as hy0, x0 + 0.72e0 * w as hx1, y0 + 0.64e0 * h as hy1 from box),
ij as (select * from (select unnest(generate_series(0, cast(ceil(w / 5000) as bigint) - 1)) as i from box) cross join (select unnest(generate_series(0, cast(ceil(h / 5000) as bigint) - 1)) as j from box)),
sq as (select i, j, x0 + i * 5000 as ax, least(x0 + (i + 1) * 5000, x1) as bx, y0 + j * 5000 as ay, least(y0 + (j + 1) * 5000, y1) as b_y, hole.* from ij cross join box cross join hole),
cut as (select *, (bx - ax) * (b_y - ay) as whole, greatest(0, least(bx, hx1) - greatest(ax, hx0)) * greatest(0, least(b_y, hy1) - greatest(ay, hy0)) as gone from sq),
clipped as (select i, j, whole - gone as area, (whole * (ax + bx) / 2 - gone * (least(bx, hx1) + greatest(ax, hx0)) / 2) / (whole - gone) as cx,
  (whole * (ay + b_y) / 2 - gone * (least(b_y, hy1) + greatest(ay, hy0)) / 2) / (whole - gone) as cy from cut where whole - gone > 1e-6)"""


@register("cell_clip_area", "i:l j:l area:f2 cx:f3 cy:f3", f"{_CLIPPED} select * from clipped")
def cell_clip_area(spark, sf_dir):
    return clipped_cells(_framed_boundary(spark, sf_dir), 5000.0)


@register(
    "grid_ids",
    "i:l j:l grid_id:s number:l",
    f"""{_CLIPPED} select i, j, 'CA5K_' || lpad(cast(row_number() over (order by i, j) - 1 as varchar), 5, '0') as grid_id,
    i * (select max(j) + 1 from ij) + j as number from clipped""",
)
def grid_ids(spark, sf_dir):
    numbered = number_cells(clipped_cells(_framed_boundary(spark, sf_dir), 5000.0), "text")
    return numbered.withColumn("number", F.col("cell"))


_LOOKUP_IDS = "ids as (select *, 'CA5K_' || lpad(cast(row_number() over (order by i, j) - 1 as varchar), 5, '0') as grid_id from clipped)"


@register(
    "clipped_grid_lookup",
    "grid_id:s lon:f6 lat:f6 i:l j:l area:f2",
    f"{_CLIPPED}, {_LOOKUP_IDS}, spots as (select grid_id, i, j, area, cx, cy from ids) select grid_id, lon_ as lon, lat_ as lat, i, j, area from ({roles.inverse_sql('spots', 'cx', 'cy')})",
)
def clipped_grid_lookup(spark, sf_dir):
    """Every clipped cell's id at the centroid of what the boundary leaves of it."""
    return clipped_lookup(_framed_boundary(spark, sf_dir), 5000.0)


# The same squares from whole-metre corners: what lies outside them is left out.
_WHOLE = _CLIPPED.replace("sq as (select i, j, x0 + i * 5000 as ax, least(x0 + (i + 1) * 5000, x1) as bx, y0 + j * 5000 as ay, least(y0 + (j + 1) * 5000, y1) as b_y,",
    "sq as (select i, j, greatest(trunc(x0) + i * 5000, x0) as ax, least(trunc(x0) + (i + 1) * 5000, x1) as bx, greatest(trunc(y0) + j * 5000, y0) as ay, least(trunc(y0) + (j + 1) * 5000, y1) as b_y,"
).replace("cast(ceil(w / 5000) as bigint)", "cast(ceil((trunc(x1) - trunc(x0)) / 5000) as bigint)").replace("cast(ceil(h / 5000) as bigint)", "cast(ceil((trunc(y1) - trunc(y0)) / 5000) as bigint)")


@register(
    "integer_grid",
    "grid_id:l lon:f6 lat:f6 area:f2",
    f"""{_WHOLE}, spots as (select i * (select max(j) + 1 from ij) + j as grid_id, area, cx, cy from clipped)
    select grid_id, lon_ as lon, lat_ as lat, area from ({roles.inverse_sql('spots', 'cx', 'cy')})""",
)
def integer_grid(spark, sf_dir):
    return clipped_lookup(_framed_boundary(spark, sf_dir), 5000.0, scheme="integer")


# Below the diagonal y = y1 - (x - x0) h / w: the integral of the line's height above a cell's foot, cut at its head.
_OBLIQUE = f"""with {roles.CELLS}, {roles.cone_sql('EPSG:3310')}, xy as ({roles.forward_sql('cells')}),
box as (select *, x1 - x0 as w, y1 - y0 as h from (select min(x) - 7000 as x0, min(y) - 7000 as y0, max(x) + 7000 as x1, max(y) + 7000 as y1 from xy)),
sq as (select *, x0 + i * 5000 as ax, x0 + (i + 1) * 5000 as bx, y0 + j * 5000 as ay from box cross join (select unnest(generate_series(0, cast(ceil(w / 5000) as bigint) - 1)) as i from box)
  cross join (select unnest(generate_series(0, cast(ceil(h / 5000) as bigint) - 1)) as j from box)),
g as (select i, j, h / w as slope, y1 - (ax - x0) * h / w - ay as ga, y1 - (bx - x0) * h / w - ay as gb from sq),
cut as (select i, j, (pow(greatest(ga, 0), 2) - pow(greatest(gb, 0), 2) - pow(greatest(ga - 5000, 0), 2) + pow(greatest(gb - 5000, 0), 2)) / (2 * slope) as area from g)
select * from cut where area > 1e-6"""


@register("oblique_clip_area", "i:l j:l area:f1", _OBLIQUE)
def oblique_clip_area(spark, sf_dir):
    """Cells cut by a boundary with a diagonal edge."""
    x0, y0, x1, y1 = _cells_box(spark, sf_dir)
    return clipped_cells(spark.createDataFrame([(0, False, [(x0, y0), (x1, y0), (x0, y1), (x0, y0)])], RINGS_SCHEMA), 5000.0)


# Holes as (left, foot, width, height): shares of the box, and metres on top.
_SLITS = [((0.31, 0.17, 0.41, 0.47), (0, 0)), ((0.12, 0.81, 0, 0), (1500, 1200)), ((0.5, 0.7, 0, 0.23), (1200, 0)), ((0.05, 0.4, 0.2, 0), (0, 900))]


def _slit_boundary(spark, sf_dir):
    """The box with a wide hole, a small one, and an upright and a level slit that cut cells in two."""
    x0, y0, x1, y1 = _cells_box(spark, sf_dir)
    w, h = x1 - x0, y1 - y0
    rings = [(0, False, _box(x0, y0, x1, y1))]
    for number, ((a, b, c, d), (p, q)) in enumerate(_SLITS, 1):
        left, foot = x0 + a * w, y0 + b * h
        rings.append((number, True, _box(left, foot, left + (c * w + p), foot + (d * h + q))))
    return spark.createDataFrame(rings, RINGS_SCHEMA)


def _box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


_SQUARES = f"""with {roles.CELLS}, {roles.cone_sql('EPSG:3310')}, xy as ({roles.forward_sql('cells')}),
box as (select *, x1 - x0 as w, y1 - y0 as h from (select min(x) - 7000 as x0, min(y) - 7000 as y0, max(x) + 7000 as x1, max(y) + 7000 as y1 from xy)),
sq as (select i, j, x0 + i * 5000 as ax, least(x0 + (i + 1) * 5000, x1) as bx, y0 + j * 5000 as ay, least(y0 + (j + 1) * 5000, y1) as b_y from box
  cross join (select unnest(generate_series(0, cast(ceil(w / 5000) as bigint) - 1)) as i from box) cross join (select unnest(generate_series(0, cast(ceil(h / 5000) as bigint) - 1)) as j from box))"""
_HOLES = "holes as (" + " union all ".join(
    f"select x0 + {a}e0 * w as lx, y0 + {b}e0 * h as ly, x0 + {a}e0 * w + ({c}e0 * w + {p}) as ux, y0 + {b}e0 * h + ({d}e0 * h + {q}) as uy from box" for (a, b, c, d), (p, q) in _SLITS
) + ")"
# What each hole takes from a square; and the corners of the rest: points with one or three of the four grounds around them, or two that face each other.
_CORNERS = f"""{_SQUARES}, {_HOLES},
gone as (select * from (select i, j, ax, bx, ay, b_y, greatest(ax, lx) as gx, least(bx, ux) as hx, greatest(ay, ly) as gy, least(b_y, uy) as hy from sq cross join holes) where gx < hx and gy < hy),
spots as (select distinct s.i, s.j, s.ax, s.bx, s.ay, s.b_y, x, y from sq s join (select i, j, ax as x from sq union select i, j, bx from sq union select i, j, gx from gone union select i, j, hx from gone) xs on xs.i = s.i and xs.j = s.j
  join (select i, j, ay as y from sq union select i, j, b_y from sq union select i, j, gy from gone union select i, j, hy from gone) ys on ys.i = s.i and ys.j = s.j),
grounds as (select i, j, x, y, u, v, x + u * 0.01e0 > ax and x + u * 0.01e0 < bx and y + v * 0.01e0 > ay and y + v * 0.01e0 < b_y
  and not exists (select 1 from gone g where g.i = p.i and g.j = p.j and x + u * 0.01e0 > gx and x + u * 0.01e0 < hx and y + v * 0.01e0 > gy and y + v * 0.01e0 < hy) as free
  from spots p cross join (values (-1), (1)) a(u) cross join (values (-1), (1)) b(v)),
corners as (select i, j, x, y, count(*) filter (free) as n, coalesce(sum(u * v) filter (free), 0) as turn from grounds group by 1, 2, 3, 4)"""


@register("cell_outline_corners", "i:l j:l x:f3 y:f3", f"{_CORNERS} select i, j, x, y from corners where n in (1, 3) or (n = 2 and abs(turn) = 2)")
def cell_outline_corners(spark, sf_dir):
    """Every corner of what a boundary with holes leaves of its cells."""
    rings = cell_polygons(_slit_boundary(spark, sf_dir), 5000.0).select("i", "j", F.explode("rings").alias("ring"))
    return rings.select("i", "j", F.inline(F.slice("ring", 1, F.size("ring") - 1))).distinct()


@register(
    "cell_outlines",
    "i:l j:l parts:l rings:l corners:l area:f2 length:f2",
    f"""{_CORNERS}, shape as (select i, j, sum(case when n in (1, 3) then 1 when n = 2 and abs(turn) = 2 then 2 else 0 end) as corners,
      sum(case when n = 1 then 1 when n = 2 and abs(turn) = 2 then 2 when n = 3 then -1 else 0 end) / 4 as bends from corners group by 1, 2),
    cut as (select i, j, sum((hx - gx) * (hy - gy)) as gone, count(*) filter (gx > ax and hx < bx and gy > ay and hy < b_y) as inside,
      sum(2 * (hx - gx) + 2 * (hy - gy) - 2 * (case when gx = ax then hy - gy else 0 end + case when hx = bx then hy - gy else 0 end + case when gy = ay then hx - gx else 0 end + case when hy = b_y then hx - gx else 0 end)) as rim from gone group by 1, 2)
    select s.i, s.j, bends + coalesce(inside, 0) as parts, bends + 2 * coalesce(inside, 0) as rings, corners, (bx - ax) * (b_y - ay) - coalesce(gone, 0) as area, 2 * (bx - ax) + 2 * (b_y - ay) + coalesce(rim, 0) as length
    from sq s join shape f on f.i = s.i and f.j = s.j left join cut c on c.i = s.i and c.j = s.j where (bx - ax) * (b_y - ay) - coalesce(gone, 0) > 1e-6""",
)
def cell_outlines(spark, sf_dir):
    """Parts, rings, corners, area and length of the outlines of every clipped cell."""
    polygons = cell_polygons(_slit_boundary(spark, sf_dir), 5000.0)
    corners = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r) - 1)

    def step(r, k):
        a, b = F.element_at(r, k), F.element_at(r, k + 1)
        return F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))

    length = F.aggregate("rings", F.lit(0.0), lambda s, r: s + F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda t, k: t + step(r, k)))
    return polygons.groupBy("i", "j").agg(F.count("*").alias("parts"), F.sum(F.size("rings")).alias("rings"), F.sum(corners).alias("corners"), F.sum("area").alias("area"), F.sum(length).alias("length"))


@register(
    "grid_features",
    "grid_id:s kind:s parts:l rings:l lon:f6 lat:f6",
    f"""{_CORNERS}, shape as (select i, j, sum(case when n = 1 then 1 when n = 2 and abs(turn) = 2 then 2 when n = 3 then -1 else 0 end) / 4 as bends from corners group by 1, 2),
    cut as (select i, j, sum((hx - gx) * (hy - gy)) as gone, sum((hx - gx) * (hy - gy) * (gx + hx) / 2) as mx, sum((hx - gx) * (hy - gy) * (gy + hy) / 2) as my, count(*) filter (gx > ax and hx < bx and gy > ay and hy < b_y) as inside from gone group by 1, 2),
    rest as (select s.i, s.j, cast(bends + coalesce(inside, 0) as bigint) as parts, cast(bends + 2 * coalesce(inside, 0) as bigint) as rings, (bx - ax) * (b_y - ay) as whole, coalesce(gone, 0) as gone, (ax + bx) / 2 as sx, (ay + b_y) / 2 as sy, coalesce(mx, 0) as mx, coalesce(my, 0) as my
      from sq s join shape f on f.i = s.i and f.j = s.j left join cut c on c.i = s.i and c.j = s.j),
    middles as (select 'CA5K_' || lpad(cast(row_number() over (order by i, j) - 1 as varchar), 5, '0') as grid_id, parts, rings, (whole * sx - mx) / (whole - gone) as cx, (whole * sy - my) / (whole - gone) as cy from rest where whole - gone > 1e-6)
    select grid_id, case when parts = 1 then 'Polygon' else 'MultiPolygon' end as kind, parts, rings, lon_ as lon, lat_ as lat from ({roles.inverse_sql('middles', 'cx', 'cy')})""",
)
def grid_features(spark, sf_dir):
    """The clipped grid written as outlines and lookup, and both read again."""
    geometry = cut_lineage(grid_geometry(_slit_boundary(spark, sf_dir), 5000.0))
    folder = f"{ensure_checkpoint_dir(spark)}/grid-{uuid.uuid4().hex}"
    write_grid(geometry, geometry.select("grid_id", "parts"), folder)
    shape = "struct<properties: struct<grid_id: string>, geometry: struct<type: string, coordinates: string>>"
    read = spark.read.text(f"{folder}/features").select(F.from_json("value", shape).alias("f")).select("f.properties.grid_id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("text", ring))).otherwise(F.from_json("text", f"array<{ring}>"))
    counted = read.withColumn("p", parts).select("grid_id", "kind", F.size("p").alias("parts"), F.aggregate("p", F.lit(0), lambda n, x: n + F.size(x)).alias("rings"))
    return counted.join(spark.read.parquet(f"{folder}/lookup"), "grid_id")


# Boxes that overlap, touch and enclose each other, as (hole, left, foot, right, head) in shares of the box; the first hole lies under another box.
_PATCHES = [
    (False, 0.0, 0.0, 0.5, 0.6), (False, 0.3, 0.4, 0.8, 0.9), (False, 0.8, 0.4, 1.0, 0.7), (False, 0.1, 0.1, 0.2, 0.2),
    (True, 0.35, 0.45, 0.45, 0.55), (True, 0.05, 0.3, 0.09, 0.38), (False, 0.8, 0.9, 1.0, 1.0),
]


def _patches(spark, sf_dir):
    x0, y0, x1, y1 = _cells_box(spark, sf_dir)
    w, h = x1 - x0, y1 - y0
    boxes = [(n, hole, _box(x0 + a * w, y0 + b * h, x0 + c * w, y0 + d * h)) for n, (hole, a, b, c, d) in enumerate(_PATCHES)]
    # Every other ring runs the other way round.
    return spark.createDataFrame([(n, hole, ring[::-1] if n % 2 else ring) for n, hole, ring in boxes], RINGS_SCHEMA)


_COVERS = "covers as (" + " union all ".join(
    f"select {-1 if hole else 1} as n, x0 + {a}e0 * w as lx, y0 + {b}e0 * h as ly, x0 + {c}e0 * w as ux, y0 + {d}e0 * h as uy from box" for hole, a, b, c, d in _PATCHES
) + ")"


@register(
    "overlap_points",
    "id:l",
    f"{_SQUARES}, {roles.POINTS}, {_COVERS}, pxy as ({roles.forward_sql('points')}) select id from pxy p where (select sum(n) from covers where p.x >= lx and p.x < ux and p.y >= ly and p.y < uy) > 0",
)
def overlap_points(spark, sf_dir):
    """Points inside a boundary whose parts overlap, touch and enclose each other."""
    return within_polygon(_projected_points(spark, sf_dir), _patches(spark, sf_dir), x="x", y="y").select("id")


@register(
    "overlap_clip_area",
    "i:l j:l area:f2 cx:f3 cy:f3",
    f"""{_SQUARES}, {_COVERS},
    xs as (select i, j, x from (select i, j, ax, bx, unnest(list_concat([ax, bx], (select list(lx) from covers), (select list(ux) from covers))) as x from sq) where x between ax and bx group by 1, 2, 3),
    ys as (select i, j, y from (select i, j, ay, b_y, unnest(list_concat([ay, b_y], (select list(ly) from covers), (select list(uy) from covers))) as y from sq) where y between ay and b_y group by 1, 2, 3),
    xr as (select i, j, x as p, lead(x) over (partition by i, j order by x) as q from xs), yr as (select i, j, y as r, lead(y) over (partition by i, j order by y) as s from ys),
    bits as (select xr.i, xr.j, p, q, r, s from xr join yr on yr.i = xr.i and yr.j = xr.j where q is not null and s is not null),
    held as (select * from bits where (select sum(n) from covers where (p + q) / 2 > lx and (p + q) / 2 < ux and (r + s) / 2 > ly and (r + s) / 2 < uy) > 0),
    sums as (select i, j, sum((q - p) * (s - r)) as area, sum((q - p) * (s - r) * (p + q) / 2) as mx, sum((q - p) * (s - r) * (r + s) / 2) as my from held group by 1, 2)
    select i, j, area, mx / area as cx, my / area as cy from sums where area > 1e-6""",
)
def overlap_clip_area(spark, sf_dir):
    return clipped_cells(_patches(spark, sf_dir), 5000.0)


@register(
    "points_in_clipped_grid",
    "id:l i:l j:l grid_id:s",
    f"""{_CLIPPED}, {roles.POINTS}, ids as (select i, j, 'CA5K_' || lpad(cast(row_number() over (order by i, j) - 1 as varchar), 5, '0') as grid_id from clipped),
    pxy as ({roles.forward_sql('points')}), inside as (select id, cast(floor((x - x0) / 5000) as bigint) as i, cast(floor((y - y0) / 5000) as bigint) as j from pxy cross join box cross join hole
    where x >= x0 and x < x1 and y >= y0 and y < y1 and not (x >= hx0 and x < hx1 and y >= hy0 and y < hy1)) select * from inside join ids using (i, j)""",
)
def points_in_clipped_grid(spark, sf_dir):
    rings = _framed_boundary(spark, sf_dir)
    return assign_to_cells(roles.points(spark, sf_dir), number_cells(clipped_cells(rings, 5000.0)), rings)


@register(
    "extent",
    "x0:f6 y0:f6 x1:f6 y1:f6",
    f"with {roles.POINTS} select min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from points",
)
def extent_query(spark, sf_dir):
    return roles.points(spark, sf_dir).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


def _lattice_bbox(spark, sf_dir):
    x0, y0, x1, y1 = extent(roles.cells(spark, sf_dir), "lon", "lat")
    return (x0, y0, x1, y1)


def _box_points_sql(steps: int) -> str:
    """Points along the four sides of the cells' lon/lat box."""
    return f"""bbox as (select min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from cells),
t as (select unnest(generate_series(0, {steps})) / {steps}e0 as t),
sides as (select x0 + t * (x1 - x0) as lon, y0 as lat from bbox cross join t union all select x0 + t * (x1 - x0), y1 from bbox cross join t
  union all select x0, y0 + t * (y1 - y0) from bbox cross join t union all select x1, y0 + t * (y1 - y0) from bbox cross join t)"""


@register(
    "cell_grid",
    "grid_id:l centroid_lat:f6 centroid_lon:f6",
    f"""with {roles.CELLS}, {roles.cone_sql('EPSG:3310')}, {_box_points_sql(1)}, xy as ({roles.forward_sql('sides')}),
    lim as (select min(x) as mx, min(y) as my, cast(ceil((max(x) - min(x) - 2500) / 5000) as bigint) as nx, cast(ceil((max(y) - min(y) - 2500) / 5000) as bigint) as ny from xy),
    ij as (select *, unnest(generate_series(0, nx * ny - 1)) as k from lim),
    ctr as (select k + 1 as grid_id, mx + 2500 + (k % nx) * 5000 as px, my + 2500 + floor(k / nx) * 5000 as py from ij)
    select grid_id, lat_ as centroid_lat, lon_ as centroid_lon from ({roles.inverse_sql('ctr', 'px', 'py')})""",
)
def cell_grid(spark, sf_dir):
    return centroid_grid(spark, _lattice_bbox(spark, sf_dir), 5000.0)


@register(
    "raster_frame",
    "row:l col:l longitude:f6 latitude:f6",
    f"""with {roles.CELLS}, {roles.cone_sql('EPSG:5070')}, {_box_points_sql(22)}, xy as ({roles.forward_sql('sides')}),
    lim as (select min(x) as mx, max(y) as my, cast(ceil((max(x) - min(x)) / 1000) as bigint) as nx, cast(ceil((max(y) - min(y)) / 1000) as bigint) as ny from xy),
    px as (select *, unnest(generate_series(0, nx * ny - 1)) as k from lim),
    ctr as (select cast(floor(k / nx) as bigint) as row, k % nx as col, mx + (k % nx + 0.5e0) * 1000 as px, my - (floor(k / nx) + 0.5e0) * 1000 as py from px)
    select row, col, lon_ as longitude, lat_ as latitude from ({roles.inverse_sql('ctr', 'px', 'py')})""",
)
def raster_frame_query(spark, sf_dir):
    return raster_frame(spark, _lattice_bbox(spark, sf_dir), 1000.0)


@register(
    "albers_project",
    "id:l x:f3 y:f3 x2:f3 y2:f3 lon_back:f8 lat_back:f8",
    f"""with {roles.POINTS}, {roles.cone_sql('EPSG:3310')}, {roles.cone_sql('EPSG:5070', 'cone2')}, one as ({roles.forward_sql('points')}),
    two as ({roles.forward_sql('one', cone='cone2', x='x2', y='y2')}) select *, lon as lon_back, lat as lat_back from two""",
)
def albers_project(spark, sf_dir):
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    x2, y2 = albers_forward("lon", "lat", "EPSG:5070")
    projected = roles.points(spark, sf_dir).select("id", x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"))
    lon_back, lat_back = albers_inverse("x2", "y2", "EPSG:5070")
    return projected.withColumns({"lon_back": lon_back, "lat_back": lat_back})


_TERRAIN_PLACE = "-121.5e0 + 0.5e0 * (p_partkey * 0.7548776662466927e0 - floor(p_partkey * 0.7548776662466927e0)) as lon, 38.1e0 + 0.4e0 * (p_partkey * 0.5698402909980532e0 - floor(p_partkey * 0.5698402909980532e0)) as lat"


def _slopes(line: str, along: str, x: str, out: str) -> str:
    w = f"(partition by {line} order by {along})"
    return f"""select *, coalesce((lead(z) over {w} - lag(z) over {w}) / (lead({x}) over {w} - lag({x}) over {w}),
      (lead(z) over {w} - z) / (lead({x}) over {w} - {x}), (z - lag(z) over {w}) / ({x} - lag({x}) over {w})) as {out}"""


@register(
    "terrain_slope",
    "p_partkey:l slope_deg:f6 aspect_deg:f6",
    f"""with {roles.cone_sql('EPSG:5070')}, smp as (select p_partkey, {_TERRAIN_PLACE}, case when p_size = 50 then null else p_retailprice + p_size end as elev from part),
    xy as ({roles.forward_sql('smp')}), keyed as (select *, case when elev is not null then round_even(x / 1000, 0) * 1000 end as xr, case when elev is not null then round_even(y / 1000, 0) * 1000 end as yr from xy),
    cell as (select xr, yr, avg(x) as x, avg(y) as y, avg(elev) as z from keyed where xr is not null group by 1, 2),
    g1 as ({_slopes('yr', 'xr', 'x', 'p')} from cell), g2 as ({_slopes('xr', 'yr', 'y', 'q')} from g1),
    res as (select xr, yr, degrees(atan(sqrt(p * p + q * q))) as slope_deg, case when p = 0 and q = 0 then null when degrees(atan2(p, -q)) < 0 then degrees(atan2(p, -q)) + 360 else degrees(atan2(p, -q)) end as aspect_deg from g2)
    select k.p_partkey, r.slope_deg, r.aspect_deg from keyed k left join res r on r.xr = k.xr and r.yr = k.yr""",
)
def terrain_slope(spark, sf_dir):
    lon, lat = roles.terrain_place("p_partkey")
    elev = F.when(F.col("p_size") != 50, F.col("p_retailprice") + F.col("p_size"))
    samples = table(spark, sf_dir, "part").select("p_partkey", lon.alias("longitude"), lat.alias("latitude"), elev.alias("elev"))
    return terrain(samples)


_CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]


def _share_sql(base: str) -> str:
    return ", ".join(f"100e0 * count(*) filter (where p_type = '{c}') / {base} as pct_{c}{'_valid' if base != 'count(*)' else ''}" for c in _CLASSES)


_VALID = "count(*) filter (where p_type in (" + ", ".join(f"'{c}'" for c in _CLASSES) + "))"


@register(
    "landcover_fraction",
    "i:l j:l " + " ".join(f"pct_{c}:f6 pct_{c}_valid:f6" for c in _CLASSES),
    f"""with {roles.cone_sql('EPSG:5070')}, px as (select p_type, {_TERRAIN_PLACE} from part), xy as ({roles.forward_sql('px')})
    select floor(x / 10000) as i, floor(y / 10000) as j, {_share_sql('count(*)')}, {_share_sql(_VALID)} from xy group by 1, 2 having {_VALID} > 0""",
)
def landcover_fraction_query(spark, sf_dir):
    """Class shares of 10 km squares; PROMO pixels stand for missing data."""
    lon, lat = roles.terrain_place("p_partkey")
    x, y = albers_forward("lon", "lat", "EPSG:5070")
    centres = table(spark, sf_dir, "part").select("p_type", lon.alias("lon"), lat.alias("lat"))
    pixels = centres.select("p_type", F.floor(x / 10000.0).alias("i"), F.floor(y / 10000.0).alias("j"))
    shares = landcover_fraction(pixels, ["i", "j"], "p_type", _CLASSES)
    valid = landcover_fraction(pixels, ["i", "j"], "p_type", _CLASSES, renormalise=True)
    return shares.join(valid.withColumnsRenamed({f"pct_{c}": f"pct_{c}_valid" for c in _CLASSES}), ["i", "j"])


# Pixels of 800 m against squares of 10 km: what a square takes of a pixel is the product of two overlaps.
_FOOTPRINTS = f"""with {roles.cone_sql('EPSG:5070')}, px as (select p_partkey, p_type, {_TERRAIN_PLACE} from part), xy as ({roles.forward_sql('px')}),
cols as (select *, unnest(generate_series(cast(floor((x - 400) / 10000) as bigint), cast(floor((x + 400) / 10000) as bigint))) as i from xy),
held as (select *, unnest(generate_series(cast(floor((y - 400) / 10000) as bigint), cast(floor((y + 400) / 10000) as bigint))) as j from cols),
cut as (select p_partkey, p_type, i, j, (least(x + 400, (i + 1) * 10000e0) - greatest(x - 400, i * 10000e0)) * (least(y + 400, (j + 1) * 10000e0) - greatest(y - 400, j * 10000e0)) as covered from held)"""


def _footprints(spark, sf_dir):
    lon, lat = roles.terrain_place("p_partkey")
    x, y = albers_forward("lon", "lat", "EPSG:5070")
    centres = table(spark, sf_dir, "part").select("p_partkey", "p_type", lon.alias("lon"), lat.alias("lat")).select("p_partkey", "p_type", x.alias("x"), y.alias("y"))
    return spread_over_cells(centres.select("p_partkey", "p_type", square_footprint(F.col("x"), F.col("y"), 800.0).alias("ring")), 10_000.0)


@register("pixel_weights", "p_partkey:l i:l j:l covered:f3 share:f6", f"{_FOOTPRINTS} select p_partkey, i, j, covered, covered / 640000e0 as share from cut where covered > 0")
def pixel_weights(spark, sf_dir):
    """What every pixel gives to the squares it lies in."""
    return _footprints(spark, sf_dir)


@register(
    "landcover_area",
    "i:l j:l " + " ".join(f"pct_{c}:f6 pct_{c}_valid:f6" for c in _CLASSES),
    f"""{_FOOTPRINTS}, v as (select *, case when p_type in ({', '.join(f"'{c}'" for c in _CLASSES)}) then covered else 0 end as known from cut)
    select i, j, {', '.join(f"100e0 * sum(case when p_type = '{c}' then covered else 0 end) / sum(covered) as pct_{c}, 100e0 * sum(case when p_type = '{c}' then covered else 0 end) / sum(known) as pct_{c}_valid" for c in _CLASSES)}
    from v group by 1, 2 having sum(known) > 0""",
)
def landcover_area(spark, sf_dir):
    """Class shares of 10 km squares by covered ground; PROMO pixels stand for missing data."""
    covered = cut_lineage(_footprints(spark, sf_dir).drop("p_partkey", "share"))
    valid = landcover_area_fraction(covered, "p_type", _CLASSES, renormalise=True)
    return landcover_area_fraction(covered, "p_type", _CLASSES).join(valid.withColumnsRenamed({f"pct_{c}": f"pct_{c}_valid" for c in _CLASSES}), ["i", "j"])


_TILE_BOX = (-124.0, 0.1, -123.4, 1e9)


@register(
    "raster_decode",
    "date:d longitude:f6 latitude:f6 ndvi:f6",
    """with px as (select vec_id, unnest(generate_series(0, len(embedding) - 1)) as i, floor(cast(unnest(embedding) as double) * 10000 + 0.5) as raw from embeddings)
    select case when vec_id % 2 = 0 then date '2023-07-01' + cast(vec_id % 92 as integer) else date '2022-06-01' + cast(vec_id % 30 as integer) end as date, -124.5e0 + i * 0.02e0 as longitude, vec_id * 0.001e0 as latitude,
      case when raw between -2000 and 3000 and raw <> 123 and (vec_id % 3 <> 0 or raw >= -1500) then raw * 0.0001e0 + case when vec_id % 3 = 0 then 0.5e0 else 0 end end as ndvi
    from px where -124.5e0 + i * 0.02e0 between -124.0e0 and -123.4e0 and vec_id * 0.001e0 >= 0.1e0""",
)
def raster_decode(spark, sf_dir):
    """Vectors as one-line tiles: stored codes, attributes, and a date in the attributes or the file name."""
    v = F.col("vec_id")
    third = v % 3 == 0
    common = {"scale_factor": "0.0001", "valid_range": "[-2000, 3000]", "_FillValue": "123"}
    day = F.date_add(F.lit("2023-07-01").cast("date"), (v % 92).cast("int"))
    attrs = F.map_concat(
        F.create_map(*[F.lit(p) for kv in common.items() for p in kv]),
        F.when(third, F.create_map(F.lit("valid_min"), F.lit("-1500"), F.lit("add_offset"), F.lit("0.5"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(v % 2 == 0, F.create_map(F.lit("time_coverage_start"), F.concat(day.cast("string"), F.lit("T00:00:00Z")))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    named = F.date_format(F.date_add(F.lit("2022-06-01").cast("date"), (v % 30).cast("int")), "yyyyMMdd")
    tiles = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("LAND_v001_"), named, F.lit("_c2.nc")).alias("file"),
        attrs.alias("attrs"),
        F.array(v * F.lit(0.001)).alias("lat"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.lit(-124.5) + i * F.lit(0.02)).alias("lon"),
        F.transform("embedding", lambda e: F.floor(e.cast("double") * 10000 + 0.5)).alias("raw"),
    )
    return tiles_to_rows(tiles, bbox=_TILE_BOX)


@register(
    "clip_and_flag",
    "vec_id:l pixel:l ndvi:f6 ndvi_missing_flag:l",
    """with px as (select vec_id, unnest(generate_series(0, len(embedding) - 1)) as pixel, cast(unnest(embedding) as double) * 6 as v from embeddings),
    m as (select vec_id, pixel, case when v > -0.9e0 then v end as v from px)
    select vec_id, pixel, case when v is not null then least(greatest(v, -1), 1) end as ndvi, cast(v is null as integer) as ndvi_missing_flag from m""",
)
def clip_and_flag(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pixel", "v"))
    masked = pixels.withColumn("v", mask_fill(F.col("v").cast("double") * 6))
    return masked.select("vec_id", "pixel", clip(F.col("v"), -1.0, 1.0).alias("ndvi"), F.col("v").isNull().cast("int").alias("ndvi_missing_flag"))


_HISTORY = f"""{roles.INCIDENTS}, {roles.nearest_sql('incidents', 'id', 'hits')}, {roles.CALENDAR},
panel as (select c.grid_id, d.date, coalesce(f.hit, 0) as fire_today from cells c cross join days d
  left join (select grid_id, date, 1 as hit from hits group by 1, 2) f on f.grid_id = c.grid_id and f.date = d.date),
hist as (select *, case when count(*) over w7 = 7 then sum(fire_today) over w7 else 0 end as fires_last_7d, case when count(*) over w14 = 14 then sum(fire_today) over w14 else 0 end as fires_last_14d
  from panel window w7 as (partition by grid_id order by date rows between 6 preceding and current row), w14 as (partition by grid_id order by date rows between 13 preceding and current row))"""


def _history(spark, sf_dir):
    cells = roles.cells(spark, sf_dir)
    index = index_cells(cells)
    at = assign_nearest(roles.incidents(spark, sf_dir), index)
    fires = at.groupBy("grid_id", "date").agg(F.lit(1).alias("fire_today"))
    panel = build_panel(densify(cells, *roles.calendar_span(spark, sf_dir)), [fires], zero_fill=["fire_today"])
    return cells, event_history(panel, "grid_id", "date", "fire_today", {"fires_last_7d": 7, "fires_last_14d": 14})


@register(
    "neighbor_lag_sum",
    "grid_id:l date:d fire_today:l fires_last_7d:l neighbor_fires_last_7d:l neighbor_fires_last_14d:l",
    f"""with {roles.CELLS}, {_PAIRS}, {_KNN}, {_HISTORY} select h.grid_id, h.date, any_value(h.fire_today) as fire_today, any_value(h.fires_last_7d) as fires_last_7d,
    sum(o.fires_last_7d) as neighbor_fires_last_7d, sum(o.fires_last_14d) as neighbor_fires_last_14d
    from hist h join knn k on k.grid_id = h.grid_id join hist o on o.grid_id = k.neighbor_id and o.date = h.date group by 1, 2""",
)
def neighbor_lag_sum(spark, sf_dir):
    cells, panel = _history(spark, sf_dir)
    return neighbor_sum(panel, cells, knn_edges(cells, 8), ["fires_last_7d", "fires_last_14d"])


_SMOOTHED = ["RH2M", "T2M", "WS10M", "ndvi", "vpd_proxy"]
_WIDE = f"""{roles.OBS}, sites as (select *, {place_sql('grid_id')} from (select distinct grid_id from obs)), site_cell as (select s.grid_id as id, s.lat, s.lon from sites s),
{roles.nearest_sql('site_cell', 'id', 'homes')},
wide as (select a.grid_id, o.date, {', '.join(f"avg(value) filter (where factor = '{f}') as {f}" for f in roles.WEATHER)} from obs o join homes a on a.id = o.grid_id group by 1, 2),
feat as (select *, WS10M / 500e0 as ndvi, (1 - RH2M / 100) * T2M as vpd_proxy from wide)"""


def _site_weather(spark, sf_dir):
    """(grid_id, date, factors): readings at sites, averaged over the sites of each cell."""
    obs = roles.observations(spark, sf_dir).withColumnRenamed("grid_id", "id")
    sites = obs.select("id").distinct().withColumns(place("id"))
    at = assign_nearest(sites, roles.cells(spark, sf_dir)).select("id", "grid_id")
    means = cell_day_mean(obs.join(at, "id"), ["grid_id", "date", "factor"], ["value"])
    return merge_factors(means, ["grid_id", "date"], "factor", "value", roles.WEATHER, how="outer")


@register(
    "radius_mean",
    "grid_id:l date:d T2M:f6 " + " ".join(f"{c}_10km:f6" for c in _SMOOTHED),
    f"""with {roles.CELLS}, {_PAIRS}, {_WIDE} select f.grid_id, f.date, any_value(f.T2M) as T2M, {', '.join(f'avg(o.{c}) as {c}_10km' for c in _SMOOTHED)}
    from feat f join pairs p on p.grid_id = f.grid_id and p.dist_km <= 10 join feat o on o.grid_id = p.neighbor_id and o.date = f.date group by 1, 2""",
)
def radius_mean_query(spark, sf_dir):
    cells = roles.cells(spark, sf_dir)
    wide = _site_weather(spark, sf_dir).withColumns({"ndvi": F.col("WS10M") / 500.0, "vpd_proxy": (F.lit(1.0) - F.col("RH2M") / 100.0) * F.col("T2M")})
    return radius_mean(wide, cells, radius_edges(cells, 10.0), {c: f"{c}_10km" for c in _SMOOTHED})


# Customers share 37 places, a few metres apart; their orders are totalled by quarter.
_CROWD_PLACE = "(c_custkey % 37)"
_CROWD = f"""crowd as (select c_custkey as grid_id, lat + (c_custkey % 5) * 0.0001e0 as lat, lon from (select *, {place_sql(_CROWD_PLACE)} from customer)),
spent as (select o_custkey as grid_id, cast(date_trunc('quarter', o_orderdate) as date) as date, avg(o_totalprice) as price, avg(case when o_orderpriority <> '1-URGENT' then o_totalprice / 1000 end) as calm from orders group by 1, 2),
ties as (select a.grid_id, b.grid_id as neighbor_id from crowd a cross join crowd b where {roles.haversine_sql('a', 'b')} <= 10)"""


def _crowd(spark, sf_dir):
    spot = place(_CROWD_PLACE)
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid_id"), (spot["lat"] + F.col("c_custkey") % 5 * F.lit(0.0001)).alias("lat"), spot["lon"].alias("lon"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid_id"), F.trunc("o_orderdate", "quarter").alias("date"), "o_totalprice", "o_orderpriority")
    calm = F.avg(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 1000))
    return cells, orders.groupBy("grid_id", "date").agg(F.avg("o_totalprice").alias("price"), calm.alias("calm"))


@register(
    "radius_mean_crowded",
    "grid_id:l date:d price:f4 price_10km:f4 calm_10km:f6",
    f"""with {_CROWD} select s.grid_id, s.date, any_value(s.price) as price, avg(o.price) as price_10km, avg(o.calm) as calm_10km
    from spent s join ties t on t.grid_id = s.grid_id join spent o on o.grid_id = t.neighbor_id and o.date = s.date group by 1, 2""",
)
def radius_mean_crowded(spark, sf_dir):
    """Means over a radius where many cells share a place."""
    cells, panel = _crowd(spark, sf_dir)
    return radius_mean_by_tiles(panel, radius_links(cells, 10.0), {"price": "price_10km", "calm": "calm_10km"})


def _cube(spark, sf_dir):
    """(date, latitude, longitude, ndvi) of the days read; 47 series share a meridian of 53 places, so that places are missing."""
    s = F.col("grid_id")
    lat, lon = F.lit(32.0) + s % 53 * F.lit(0.5), F.lit(-124.0) + F.floor(s / 47.0) * F.lit(0.5)
    return roles.daily_series(spark, sf_dir).select("date", lat.alias("latitude"), lon.alias("longitude"), "ndvi")


def _prev_next(value: str, axis: str, part: str, out: str, tail: str) -> str:
    """Known values and their places before and after, within ``part`` along ``axis``."""
    back = f"over (partition by {part} order by {axis} rows between unbounded preceding and current row)"
    ahead = f"over (partition by {part} order by {axis} rows between current row and unbounded following)"
    known = f"case when {value} is not null then {axis} end"
    return f"""{out} as (select *, last_value({value} ignore nulls) {back} as pv, last_value({known} ignore nulls) {back} as pa,
      first_value({value} ignore nulls) {ahead} as nv, first_value({known} ignore nulls) {ahead} as na from {tail})"""


_CUBE = f"""with {roles.DAILY}, read as (select date, 32e0 + (grid_id % 53) * 0.5e0 as latitude, -124e0 + floor(grid_id / 47e0) * 0.5e0 as longitude, ndvi from daily),
cube as (select d.date, a.latitude, o.longitude, r.ndvi from (select distinct date from read) d cross join (select distinct latitude from read) a cross join (select distinct longitude from read) o
  left join read r on r.date = d.date and r.latitude = a.latitude and r.longitude = o.longitude),
{_prev_next('ndvi', 'date', 'latitude, longitude', 'c1', 'cube')},
timed as (select date, latitude, longitude, ndvi, case when ndvi is not null then ndvi when pv is not null and nv is not null
  then pv + (nv - pv) * (date_diff('day', pa, date) / cast(date_diff('day', pa, na) as double)) end as t from c1)"""


@register("cube_time_fill", "date:d latitude:f3 longitude:f3 ndvi:f6 ndvi_filled:f6", f"{_CUBE} select *, t as ndvi_filled from timed")
def cube_time_fill(spark, sf_dir):
    return fill_time(densify_cube(_cube(spark, sf_dir)), ["latitude", "longitude"], "date", "ndvi", "ndvi_filled", limit=None, ends=False)


def _near_sql(value: str, axis: str, out: str) -> str:
    return f"case when {value} is not null then {value} when pv is not null and nv is not null then case when {axis} - pa <= na - {axis} then pv else nv end end as {out}"


@register(
    "cube_nearest_fill",
    "date:d latitude:f3 longitude:f3 ndvi:f6 ndvi_filled:f6",
    f"""{_CUBE}, {_prev_next('t', 'latitude', 'date, longitude', 'c2', 'timed')}, down as (select date, latitude, longitude, ndvi, t, {_near_sql('t', 'latitude', 'u')} from c2),
    {_prev_next('u', 'longitude', 'date, latitude', 'c3', 'down')}, across as (select date, latitude, longitude, ndvi, {_near_sql('u', 'longitude', 'w')} from c3)
    select *, case when max(case when ndvi is not null then 1 else 0 end) over (partition by latitude, longitude) = 1 then w end as ndvi_filled from across""",
)
def cube_nearest_fill(spark, sf_dir):
    return fill_cube(_cube(spark, sf_dir), "ndvi", "ndvi_filled")


@register("radius_degree", "grid_id:l links:l", f"with {roles.CELLS}, {_PAIRS} select grid_id, count(*) as links from pairs where dist_km <= 10 group by 1")
def radius_degree(spark, sf_dir):
    """Links per cell of a materialised radius graph, as reused across days."""
    return cut_lineage(radius_edges(roles.cells(spark, sf_dir), 10.0)).groupBy("grid_id").agg(F.count("*").alias("links"))
