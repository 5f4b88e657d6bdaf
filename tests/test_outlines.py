"""Outlines of clipped cells and united parts, against winding numbers counted point by point."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import grid, outlines, polygons
from terrapanel.sources import sinks


def winding(rings, holes, x, y):
    total = 0
    for ring, hole in zip(rings, holes, strict=True):
        ring = np.asarray(ring)
        if (outlines.signed_area(ring) > 0) == hole:
            ring = ring[::-1]
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                total += 1 if y2 > y1 else -1
    return total


def star(rng, x, y, size, points):
    angle = np.sort(rng.uniform(0, 2 * math.pi, points))
    reach = rng.uniform(0.3, 1, points) * size
    ring = np.stack([x + reach * np.cos(angle), y + reach * np.sin(angle)], axis=1)
    return np.concatenate([ring, ring[:1]])


def box(a, b, c, d):
    return np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], dtype=float)


def in_parts(parts, x, y):
    return sum(winding(part, [False] + [True] * (len(part) - 1), x, y) > 0 for part in parts)


CASES = {
    "overlap": ([box(0, 0, 10, 10), box(5, 5, 15, 15)], [False, False]),
    "touch": ([box(0, 0, 10, 10), box(10, 2, 15, 8)], [False, False]),
    "corner": ([box(0, 0, 10, 10), box(10, 10, 15, 15)], [False, False]),
    "nested": ([box(0, 0, 10, 10), box(2, 2, 4, 4)], [False, False]),
    "equal": ([box(0, 0, 10, 10), box(0, 0, 10, 10)[::-1]], [False, False]),
    "hole": ([box(0, 0, 10, 10), box(2, 2, 4, 4)], [False, True]),
    "hole at the rim": ([box(0, 0, 10, 10), box(0, 2, 4, 4)], [False, True]),
    "hole touches in a corner": ([box(0, 0, 10, 10), np.array([(0.0, 0.0), (4, 1), (1, 4), (0, 0)])], [False, True]),
    "island in a hole": ([box(0, 0, 10, 10), box(2, 2, 8, 8), box(4, 4, 6, 6)], [False, True, False]),
    "hole under another part": ([box(0, 0, 10, 10), box(2, 2, 4, 4), box(1, 1, 5, 5)], [False, True, False]),
    "cut in two": ([box(0, 0, 10, 10), box(4, -1, 6, 11)], [False, True]),
    "all gone": ([box(0, 0, 10, 10), box(-1, -1, 11, 11)], [False, True]),
    "back and forth": ([np.array([(0.0, 0.0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10), (0, 0)])], [False]),
}
AREAS = {"overlap": 175, "touch": 130, "corner": 125, "nested": 100, "equal": 100, "hole": 96, "hole at the rim": 92, "hole touches in a corner": 92.5, "island in a hole": 68, "hole under another part": 100, "cut in two": 80, "all gone": 0, "back and forth": 100}
SHAPES = {"overlap": [1], "touch": [1], "corner": [1, 1], "nested": [1], "equal": [1], "hole": [2], "hole at the rim": [1], "hole touches in a corner": [2], "island in a hole": [2, 1], "hole under another part": [1], "cut in two": [1, 1], "all gone": [], "back and forth": [1]}


@pytest.mark.parametrize("name", CASES)
def test_known_unions(name):
    parts = outlines.united_parts(*CASES[name])
    assert [len(p) for p in parts] == SHAPES[name]
    assert math.isclose(sum(outlines.part_moments(p)[0] for p in parts), AREAS[name], abs_tol=1e-6)


def test_random_unions():
    """Stars and boxes on a coarse lattice, so that edges overlap, touch and cross."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        rings, holes = [], []
        for _ in range(rng.integers(1, 7)):
            if rng.random() < 0.5:
                a, b = rng.integers(0, 8, 2)
                c, d = rng.integers(1, 5, 2)
                rings.append(box(a, b, a + c, b + d))
            else:
                rings.append(star(rng, *rng.uniform(2, 8, 2), 4, rng.integers(3, 12)))
            holes.append(bool(rng.random() < 0.25))
        parts = outlines.united_parts([r + 1e6 for r in rings], holes)
        for x, y in rng.uniform(-1, 13, (200, 2)):
            assert in_parts(parts, x + 1e6, y + 1e6) == (winding(rings, holes, x, y) > 0), (seed, x, y)
        for part in parts:
            assert outlines.signed_area(part[0]) > 0 and all(outlines.signed_area(h) < 0 for h in part[1:])
            assert all(len({tuple(v) for v in ring}) == len(ring) - 1 and (ring[0] == ring[-1]).all() for ring in part)


RINGS = [
    (0, False, [(0.0, 0.0), (37.0, 4.0), (31.0, 22.0), (18.0, 11.0), (6.0, 27.0), (0.0, 0.0)]),
    (1, True, [(4.0, 5.0), (9.0, 6.0), (6.0, 12.0), (4.0, 5.0)]),
    (2, False, [(30.0, 20.0), (42.0, 20.0), (42.0, 30.0), (30.0, 30.0), (30.0, 20.0)][::-1]),
]


def test_polygons_of_cells(spark):
    rings = spark.createDataFrame(RINGS, polygons.RINGS_SCHEMA)
    for boundary in (rings, rings.where("ring_id < 2"), rings.where("ring_id = 0")):
        cells = {(r.i, r.j): (r.area, r.cx, r.cy) for r in grid.clipped_cells(boundary, 3.0).collect()}
        found: dict = {}
        for r in grid.cell_polygons(boundary, 3.0).collect():
            parts = found.setdefault((r.i, r.j), [])
            parts.append(([np.array(ring) for ring in r.rings], r.area, r.cx, r.cy))
        assert set(cells) <= set(found)
        for key, (area, cx, cy) in cells.items():
            size = sum(p[1] for p in found[key])
            assert math.isclose(size, area, rel_tol=1e-9) and math.isclose(sum(p[1] * p[2] for p in found[key]) / size, cx, rel_tol=1e-7, abs_tol=1e-7)
            assert all(3 * key[0] - 1e-6 <= x <= 3 * key[0] + 3 + 1e-6 and 3 * key[1] - 1e-6 <= y <= 3 * key[1] + 3 + 1e-6 for p in found[key] for ring in p[0] for x, y in ring)
    # Against points of the plane: one part, and no other, holds each point inside.
    everything = [(np.array(r), h) for _, h, r in RINGS]
    rng = np.random.default_rng(3)
    parts_of = {(r.i, r.j): [] for r in grid.cell_polygons(rings, 3.0).collect()}
    for r in grid.cell_polygons(rings, 3.0).collect():
        parts_of[r.i, r.j].append([np.array(ring) for ring in r.rings])
    for x, y in rng.uniform(0, 42, (1500, 2)):
        inside = winding([r for r, _ in everything], [h for _, h in everything], x, y) > 0
        assert in_parts(parts_of.get((int(x // 3), int(y // 3)), []), x, y) == inside


def test_overlaps_count_once(spark):
    """Points and areas of overlapping, touching, nested and repeated boxes, with and without holes."""
    boxes = {"overlap": ([(0, 0, 10, 10), (5, 0, 15, 10)], 150), "touch": ([(0, 0, 10, 10), (10, 0, 15, 10)], 150), "nested": ([(0, 0, 15, 10), (2, 2, 4, 4)], 150), "equal": ([(0, 0, 15, 10)] * 3, 150)}
    points = spark.createDataFrame([(k, 0.25 + k % 40 * 0.5, 0.25 + k // 40 * 0.5) for k in range(1600)], "id long, lon double, lat double")
    for shape, area in boxes.values():
        rings = spark.createDataFrame([(n, False, [tuple(v) for v in box(*b).tolist()]) for n, b in enumerate(shape)], polygons.RINGS_SCHEMA)
        assert math.isclose(grid.clipped_cells(rings, 4.0).agg(F.sum("area")).first()[0], area, rel_tol=1e-9)
        assert polygons.within_polygon(points, rings).count() == area * 4


def test_grid_files(spark, tmp_path):
    """Outlines of the clipped grid, written and read: lookup and features agree, in degrees."""
    shifted = [(n, hole, [(x * 1000.0, y * 1000.0) for x, y in ring]) for n, hole, ring in RINGS]
    geometry = grid.grid_geometry(spark.createDataFrame(shifted, polygons.RINGS_SCHEMA), 5000.0)
    sinks.write_grid(geometry, geometry, str(tmp_path / "g"))
    features = {}
    for row in spark.read.text(str(tmp_path / "g" / "features")).collect():
        feature = json.loads(row.value)
        shape = feature["geometry"]
        features[feature["properties"]["grid_id"]] = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
    lookup = {r.grid_id: (r.lon, r.lat) for r in spark.read.parquet(str(tmp_path / "g" / "lookup")).collect()}
    expected = {r.grid_id: (r.lon, r.lat) for r in grid.cell_grid(spark.createDataFrame(shifted, polygons.RINGS_SCHEMA), 5000.0).collect()}
    assert set(features) == set(lookup) == set(expected) and len(lookup) > 30
    for grid_id, (lon, lat) in expected.items():
        assert math.isclose(lookup[grid_id][0], lon, abs_tol=1e-9) and math.isclose(lookup[grid_id][1], lat, abs_tol=1e-9)
        corners = [v for polygon in features[grid_id] for v in polygon[0]]
        assert min(c[0] for c in corners) <= lon <= max(c[0] for c in corners) and min(c[1] for c in corners) <= lat <= max(c[1] for c in corners)
        assert all(ring[0] == ring[-1] for polygon in features[grid_id] for ring in polygon)
