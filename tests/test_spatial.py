import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions.geo import Albers, albers_forward, albers_inverse
from terrapanel import session
from terrapanel.operators import grid, neighbors, polygons, spatial
from terrapanel.operators.terrain import terrain
from terrapanel.operators.timeseries import event_history


def haversine(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h)))


@pytest.fixture(scope="module")
def scattered():
    """Spread cells, one dense cluster with a third of them, some anywhere on Earth; points likewise, plus one hot spot."""
    rng = np.random.default_rng(5)
    cells = pd.DataFrame({"grid_id": np.arange(600), "lat": np.r_[rng.uniform(32, 42, 350), 38 + rng.normal(0, 0.01, 200), rng.uniform(-90, 90, 50)]})
    cells["lon"] = np.r_[rng.uniform(-125, -113, 350), -120 + rng.normal(0, 0.01, 200), rng.uniform(-180, 180, 50)]
    points = pd.DataFrame({"id": np.arange(900), "lat": np.r_[rng.uniform(32, 42, 400), rng.uniform(-90, 90, 200), np.full(300, 38.001)]})
    points["lon"] = np.r_[rng.uniform(-125, -113, 400), rng.uniform(-180, 180, 200), np.full(300, -120.002)]
    return cells, points


def distances(a, b):
    return haversine(a.lat.values[:, None], a.lon.values[:, None], b.lat.values[None], b.lon.values[None])


@pytest.mark.parametrize("limit", [session.BROADCAST_BYTES, 0])
def test_nearest_equals_all_pairs(spark, scattered, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    cells, points = scattered
    got = spatial.assign_nearest(spark.createDataFrame(points), spark.createDataFrame(cells)).toPandas().sort_values("id")
    all_pairs = distances(points, cells)
    assert (got.grid_id.values == all_pairs.argmin(axis=1)).all()
    np.testing.assert_allclose(got.dist_km.values, all_pairs.min(axis=1), atol=1e-9)


def test_nearest_keeps_rows_without_coordinates_and_prefers_low_ids(spark):
    cells = spark.createDataFrame([(7, 10.0, 10.0), (3, 10.0, 10.0), (9, 11.0, 10.0)], "grid_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 10.1, 10.0), (2, None, 10.0)], "id long, lat double, lon double")
    assert {r.id: r.grid_id for r in spatial.assign_nearest(points, cells).collect()} == {1: 3, 2: None}


def test_knn_and_radius_equal_all_pairs(spark, scattered):
    cells, _ = scattered
    frame = spark.createDataFrame(cells)
    all_pairs = distances(cells, cells)
    edges = spatial.knn_edges(frame, 8).toPandas().sort_values(["grid_id", "rank"])
    others = all_pairs.copy()
    np.fill_diagonal(others, np.inf)
    np.testing.assert_allclose(edges.dist_km.values, np.sort(others, axis=1)[:, :8].ravel(), atol=1e-9)
    for km in (5, 800):
        assert spatial.radius_edges(frame, km).count() == (all_pairs <= km).sum()


def test_albers_published_example(spark):
    clarke = Albers(29.5, 45.5, 23.0, -96.0, a=6378206.4, f=1 / 294.978698214)
    x, y = albers_forward("lon", "lat", clarke)
    row = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 1885472.7) < 0.1 and abs(row.y - 1535925.0) < 0.1


def test_albers_state_plane_origin_and_round_trip(spark):
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    row = spark.createDataFrame([(-120.0, 37.5)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x) < 1e-6 and abs(row.y + 57402.446) < 1e-3
    grid_points = spark.range(400).selectExpr("-124D + (id % 20) * 0.5D as lon", "32.1D + (id div 20) * 0.5D as lat")
    for crs in ("EPSG:3310", "EPSG:5070"):
        px, py = albers_forward("lon", "lat", crs)
        lon, lat = albers_inverse("px", "py", crs)
        back = grid_points.select("lon", "lat", px.alias("px"), py.alias("py")).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
        assert max(back) < 1e-9


def test_centroid_grid_size(spark):
    cells = grid.centroid_grid(spark, (-125.0, 32.0, -113.0, 42.5), 5000.0)
    assert cells.count() == 227 * 235
    assert cells.agg(F.min("grid_id"), F.max("grid_id")).first() == (1, 53345)


RINGS = [
    (0, False, [(0.0, 0.0), (37.0, 4.0), (31.0, 22.0), (18.0, 11.0), (6.0, 27.0), (0.0, 0.0)]),
    (1, True, [(4.0, 5.0), (9.0, 6.0), (6.0, 12.0), (4.0, 5.0)]),
]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def even_odd(x, y):
    crossings = 0
    for _, _, ring in RINGS:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                crossings += 1
    return crossings % 2 == 1


def test_polygon_membership(spark):
    rng = np.random.default_rng(1)
    points = pd.DataFrame({"id": range(2000), "lon": rng.uniform(-3, 40, 2000), "lat": rng.uniform(-3, 30, 2000)})
    inside = polygons.within_polygon(spark.createDataFrame(points), spark.createDataFrame(RINGS, polygons.RINGS_SCHEMA))
    assert {r.id for r in inside.collect()} == {r.id for r in points.itertuples() if even_odd(r.lon, r.lat)}


def test_clipped_cells_cover_the_polygon_exactly(spark):
    cells = grid.clipped_cells(spark.createDataFrame(RINGS, polygons.RINGS_SCHEMA), 3.0).toPandas()
    assert math.isclose(cells.area.sum(), area(RINGS[0][2]) - area(RINGS[1][2]), rel_tol=1e-9)
    assert (cells.area <= 9 + 1e-9).all()
    whole = cells[np.isclose(cells.area, 9)]
    assert len(whole) and np.allclose(whole.cx, whole.i * 3 + 1.5) and np.allclose(whole.cy, whole.j * 3 + 1.5)
    # A fine raster agrees with the area of every cut cell.
    for cell in cells.sample(5, random_state=1).itertuples():
        t = (np.arange(60) + 0.5) / 20
        hits = sum(even_odd(cell.i * 3 + a, cell.j * 3 + b) for a in t for b in t)
        assert abs(hits / 400 - cell.area) < 0.25


def test_dense_cell_numbers(spark):
    cells = grid.number_cells(grid.clipped_cells(spark.createDataFrame(RINGS, polygons.RINGS_SCHEMA), 3.0), "text").toPandas().sort_values(["i", "j"])
    assert list(cells.grid_id) == [f"CA5K_{n:05d}" for n in range(len(cells))]


def test_slope_of_a_plane(spark):
    rows = spark.range(400).selectExpr("-121D + (id % 20) * 0.02D as longitude", "38D + (id div 20) * 0.02D as latitude", "100D as elev")
    flat = terrain(rows).agg(F.max("slope_deg"), F.count("aspect_deg")).first()
    assert flat == (0.0, 0)


@pytest.mark.parametrize("limit", [session.BROADCAST_BYTES, 0])
def test_neighbour_features(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    cells = spark.createDataFrame([(1, 35.0, -120.0), (2, 35.05, -120.0), (3, 36.0, -120.0)], "grid_id long, lat double, lon double")
    panel = spark.createDataFrame([(1, "d1", 2), (2, "d1", 5), (3, "d1", 7), (1, "d2", 1)], "grid_id long, date string, n int")
    edges = spatial.knn_edges(cells, 2)
    got = {(r.grid_id, r.date): r.neighbor_n for r in neighbors.neighbor_sum(panel, cells, edges, ["n"]).collect()}
    assert got == {(1, "d1"): 12, (2, "d1"): 9, (3, "d1"): 7, (1, "d2"): 0}
    near = spatial.radius_edges(cells, 10)
    mean = {(r.grid_id, r.date): r.m for r in neighbors.radius_mean(panel, cells, near, {"n": "m"}).collect()}
    assert mean == {(1, "d1"): 3.5, (2, "d1"): 3.5, (3, "d1"): 7.0, (1, "d2"): 1.0}


def exchanges_of(df, column):
    """Hash exchanges in the physical plan that carry ``column``."""
    plan = df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and column in line]


def test_panel_rows_travel_once(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.range(200).selectExpr("id as grid_id", "35 + id * 0.05D as lat", "-120D as lon")
        days = cells.select("grid_id").join(spark.range(3).selectExpr("id as date"))
        panel = event_history(days.withColumn("hit", (F.col("grid_id") % 3 == 0).cast("int")), "grid_id", "date", "hit", {"past": 2})
        out = neighbors.neighbor_sum(panel, cells, spatial.knn_edges(cells, 2), ["past"])
        assert len(exchanges_of(out, "_tile")) == 1
        assert out.count() == 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiles_hold_a_bounded_number_of_cells(spark):
    cells = spark.range(4000).selectExpr("id as grid_id", "35 + (id % 64) * 0.01D as lat", "-120 + floor(id / 64) * 0.01D as lon")
    level = neighbors.tile_level(cells, most=100)
    tiles = cells.groupBy(spatial.bucket_of("lat", "lon", level).alias("t")).count()
    assert tiles.agg(F.max("count")).first()[0] <= 100 < cells.groupBy(spatial.bucket_of("lat", "lon", level - 1).alias("t")).count().agg(F.max("count")).first()[0]


def test_many_cells_at_one_place(spark):
    cells = spark.range(10_000).selectExpr("id as grid_id", "if(id < 9990, 35D, 35D + id * 0.001D) as lat", "-120D as lon")
    edges = spatial.knn_edges(cells, 3).where("grid_id in (0, 2, 5000, 9995)").toPandas()
    found = {k: g.sort_values("rank").neighbor_id.tolist() for k, g in edges.groupby("grid_id")}
    assert found[0] == [1, 2, 3] and found[2] == [0, 1, 3] and found[5000] == [0, 1, 2] and set(found[9995]) == {9994, 9996, 9993} or found[9995][:2] == [9994, 9996]
    near = spatial.assign_nearest(spark.createDataFrame([(1, 35.0, -120.0)], "id long, lat double, lon double"), cells)
    assert near.first().grid_id == 0


def test_nearest_reads_the_points_once(spark, scattered, tmp_path):
    cells, points = scattered
    spark.createDataFrame(points).write.parquet(str(tmp_path / "points"))
    found = spatial.assign_nearest(spark.read.parquet(str(tmp_path / "points")), spark.createDataFrame(cells))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_a_comb_makes_edge_copies_in_proportion(spark):
    from terrapanel.operators.polygons import band_count, within_polygon

    for teeth in (100, 1000, 10_000):
        bands, copies = band_count(2 * teeth, 2.0 * teeth, 1.0)
        assert 1 <= bands and copies <= 6 * 2 * teeth + 1
    ring = [(0.0, 0.0)] + [v for i in range(200) for v in ((i + 0.5, 1.0), (i + 1.0, 0.0))] + [(200.0, -1.0), (0.0, -1.0), (0.0, 0.0)]
    comb = spark.createDataFrame([(0, False, ring)], "ring_id long, hole boolean, ring array<struct<x: double, y: double>>")
    points = [(i, 0.37 * i + 0.0013, 0.5) for i in range(500)]
    inside = {r.id for r in within_polygon(spark.createDataFrame(points, "id long, lon double, lat double"), comb).collect()}
    assert inside == {i for i, x, _ in points if x < 200 and 0.25 < x % 1 < 0.75}


def test_rings_are_projected_vertex_by_vertex(spark):
    ring = [(-120.0, 37.5), (-119.0, 37.5), (-119.0, 38.0), (-120.0, 37.5)]
    out = polygons.project_rings(spark.createDataFrame([(0, False, ring)], polygons.RINGS_SCHEMA)).first().ring
    assert abs(out[0].x) < 1e-6 and abs(out[0].y + 57402.446) < 0.01 and out[0] == out[3]
