"""Area-weighted land cover, neighbour-based mutual information, and radius means by tiles, against plain forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import landcover, neighbors, outlines, radius, sampling, spatial


def turned_square(x, y, size, angle):
    corners = [(-size / 2, -size / 2), (size / 2, -size / 2), (size / 2, size / 2), (-size / 2, size / 2), (-size / 2, -size / 2)]
    c, s = math.cos(angle), math.sin(angle)
    return [(float(x + c * a - s * b), float(y + s * a + c * b)) for a, b in corners]


def test_a_pixels_shares_sum_to_one(spark):
    """Pixels of any direction and size, inside one square, across sides and corners, and larger than squares."""
    rng = np.random.default_rng(1)
    rows = [(n, "abx"[n % 3], turned_square(*rng.uniform(-30, 30, 2), size, rng.uniform(0, 6))) for n, size in enumerate(rng.uniform(0.5, 25, 200))]
    rows += [(200, "a", turned_square(5.0, 5.0, 10.0, 0.0)), (201, "a", None), (202, "b", [(0.0, 0.0)] * 5)]
    pixels = spark.createDataFrame(rows, "id long, code string, ring array<struct<x: double, y: double>>")
    spread = landcover.spread_over_cells(pixels, 10.0, x0=-3.0, y0=2.0).toPandas()
    assert set(spread.id) == set(range(201)) and np.allclose(spread.groupby("id").share.sum(), 1)
    by_pixel = {n: (code, np.array(ring)) for n, code, ring in rows[:201]}
    for n, i, j, covered in spread[["id", "i", "j", "covered"]].sample(150, random_state=1).itertuples(index=False):
        # What the pixel and the square share, as the union's complement.
        x, y = -3.0 + 10 * i, 2.0 + 10 * j
        square = np.array([(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y)])
        ring = by_pixel[n][1]
        both = sum(outlines.part_moments(p)[0] for p in outlines.united_parts([square, ring], [False, False]))
        assert math.isclose(covered, abs(outlines.signed_area(ring)) + 100 - both, abs_tol=1e-5)
    shares = landcover.landcover_area_fraction(spark.createDataFrame(spread), "code", ["a", "b"]).toPandas()
    known = landcover.landcover_area_fraction(spark.createDataFrame(spread), "code", ["a", "b"], renormalise=True).toPandas()
    assert np.allclose(known.pct_a + known.pct_b, 100) and (shares.pct_a + shares.pct_b <= 100 + 1e-9).all()
    ground = spread.groupby(["i", "j", "code"]).covered.sum().unstack(fill_value=0.0)
    for r in shares.itertuples():
        assert math.isclose(r.pct_a, 100 * ground.loc[(r.i, r.j), "a"] / ground.loc[(r.i, r.j)].sum(), rel_tol=1e-9)


def test_a_footprint_that_is_worked_out_is_so_once(spark, capsys):
    """What a pixel's ring is made of stands in the plan once a corner, not once for every use of the ring."""
    pixels = spark.range(40).select("id", landcover.square_footprint(F.hypot(F.col("id") * 7.0, F.lit(1.0)), F.col("id") * 3.0, 4.0).alias("ring"))
    spread = landcover.spread_over_cells(pixels, 10.0)
    spread.explain()
    assert capsys.readouterr().out.lower().count("hypot") <= 5
    found = spread.groupBy("id").agg(F.sum("covered").alias("c"), F.sum("share").alias("s"), F.count("*").alias("n")).toPandas()
    assert len(found) == 40 and np.allclose(found.c, 16) and np.allclose(found.s, 1) and found.n.max() == 4


def digamma(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def plain_information(x, y, k=3):
    keep = [i for i in range(len(x)) if x[i] == x[i] and y[i] is not None]
    x, y = np.array([x[i] for i in keep]), np.array([y[i] for i in keep])
    size = {c: (y == c).sum() for c in set(y)}
    keep = np.array([size[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    terms = []
    for i in range(len(x)):
        own = np.sort(np.abs(x[(y == y[i]) & (np.arange(len(x)) != i)] - x[i]))
        kk = min(k, len(own))
        d = own[kk - 1]
        m = ((x > x[i] - d) & (x < x[i] + d)).sum() if d else (x == x[i]).sum()
        terms.append(digamma(kk) - digamma(size[y[i]]) - digamma(m))
    return max(0.0, digamma(len(x)) + float(np.mean(terms))) if len(x) else 0.0


@pytest.mark.parametrize("k", [1, 3, 7])
def test_information_from_neighbours(spark, k):
    """Continuous, tied, constant and skewed features, a class of one row, NULLs."""
    rng = np.random.default_rng(k)
    n = 700
    label = rng.integers(0, 3, n)
    rows = pd.DataFrame({"y": label, "a": rng.normal(label, 0.5), "b": rng.integers(0, 9, n).astype(float), "c": 1.0, "d": np.exp(rng.normal(0, 3, n) + label)})
    rows.loc[:5, "a"] = np.nan
    rows.loc[6, "y"] = 77
    df = spark.createDataFrame(rows).withColumn("y", F.when(F.col("y") != 2, F.col("y")).otherwise(F.when(F.rand(3) > 0, 2)))
    df = df.replace(float("nan"), None)
    got = {r.feature: r.mi for r in sampling.mutual_information_neighbours(df, list("abcd"), "y", k).collect()}
    for c in "abcd":
        assert math.isclose(got[c], plain_information(rows[c].to_numpy(), rows.y.tolist(), k), abs_tol=1e-9), c
    assert got["a"] > 0.2 and got["a"] > got["b"]


def test_one_outlier_does_not_change_the_ranking(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 2, 2000)
    rows = pd.DataFrame({"y": label, "strong": rng.normal(3 * label, 1), "weak": rng.normal(0.5 * label, 1), "noise": rng.normal(0, 1, 2000)})
    far = rows.copy()
    far.loc[0, "strong"] = 1e9
    names = ["strong", "weak", "noise"]
    near, out = ({r.feature: r.mi for r in sampling.mutual_information_neighbours(spark.createDataFrame(t), names, "y").collect()} for t in (rows, far))
    assert sorted(names, key=near.get) == sorted(names, key=out.get) == ["noise", "weak", "strong"] and abs(near["strong"] - out["strong"]) < 0.01
    binned = {r.feature: r.mi for r in sampling.mutual_information(spark.createDataFrame(far), names, "y").collect()}
    assert binned["strong"] < binned["weak"]  # the outlier leaves all other rows in one bin
    assert sampling.mutual_information_neighbours(spark.createDataFrame(rows).limit(0), names, "y").toPandas().mi.tolist() == [0.0] * 3


def crowds(rng):
    """Cells spread out, in dense places, all at one place, and around the whole Earth."""
    spread = [(rng.uniform(35, 36), rng.uniform(-121, -120)) for _ in range(150)]
    dense = [(35.5 + rng.normal(0, 0.03), -120.5 + rng.normal(0, 0.03)) for _ in range(150)]
    heap = [(35.2, -120.2)] * 100 + [(35.2 + 0.0899321, -120.2)] * 40
    far = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    return pd.DataFrame([(n, *p) for n, p in enumerate(spread + dense + heap + far)], columns=["grid_id", "lat", "lon"])


@pytest.mark.parametrize("km", [3.0, 10.0, 900.0])
def test_radius_links_are_all_pairs(spark, km):
    cells = spark.createDataFrame(crowds(np.random.default_rng(4)))
    links = radius.radius_links(cells, km)
    nodes = links.members
    far = links.tiles.join(nodes, "node").join(nodes.withColumnsRenamed({"node": "other", "grid_id": "neighbor_id"}), "other").select("grid_id", "neighbor_id")
    found = links.near.unionByName(far)
    expected = spatial.radius_edges(cells, km).select("grid_id", "neighbor_id")
    assert found.count() == expected.count() == found.distinct().count() and found.exceptAll(expected).count() == 0


def test_radius_means_by_tiles(spark):
    rng = np.random.default_rng(5)
    cells = crowds(rng)
    frame = spark.createDataFrame(cells)
    panel = pd.DataFrame([(g, d, rng.normal(), None if rng.random() < 0.3 else rng.normal()) for g in cells.grid_id for d in (1, 2, 3) if rng.random() < 0.9], columns=["grid_id", "date", "a", "b"])
    rows = spark.createDataFrame(panel, "grid_id long, date int, a double, b double").replace(float("nan"), None)
    want = neighbors.radius_mean(rows, frame, spatial.radius_edges(frame, 10.0), {"a": "a10", "b": "b10"}).toPandas().sort_values(["grid_id", "date"])
    got = radius.radius_mean_by_tiles(rows, radius.radius_links(frame, 10.0), {"a": "a10", "b": "b10"}).toPandas().sort_values(["grid_id", "date"])
    assert len(got) == len(panel)
    for c in ("grid_id", "date", "a", "b", "a10", "b10"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)


def test_ten_thousand_cells_at_one_place_cost_linear_rows(spark):
    cells = spark.range(10_000).selectExpr("id as grid_id", "35D + (id % 2) * 0.0001D as lat", "-120D as lon")
    links = radius.radius_links(cells, 10.0)
    assert links.near.count() + links.tiles.count() + links.members.count() < 25_000
    panel = cells.selectExpr("grid_id", "1 as date", "cast(grid_id as double) as v")
    assert radius.radius_mean_by_tiles(panel, links, {"v": "m"}).agg(F.min("m"), F.max("m"), F.count("m")).first() == (4999.5, 4999.5, 10_000)
    assert radius.radius_links(cells.limit(0), 10.0).near.count() == 0


def measured(df, metric, of="numOutputRows"):
    """What the steps of the plan that ran, those that also have the metric ``of``, say of one metric."""
    df.collect()
    found, open_nodes = [], [df._jdf.queryExecution().executedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        value, other = node.metrics().get(metric), node.metrics().get(of)
        found += [value.get().value()] if value.isDefined() and other.isDefined() else []
        kind = node.getClass().getSimpleName()
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
        open_nodes += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
    return found


def test_totals_of_a_tile_go_to_rows_not_to_every_cell_on_every_day(spark):
    cells = spark.range(400).selectExpr("id as grid_id", "35D + (id % 2) * 0.0001D as lat", "-120D as lon")
    panel = cells.selectExpr("grid_id", "cast(grid_id as int) as date", "cast(grid_id as double) as v")
    means = radius.radius_mean_by_tiles(panel, radius.radius_links(cells, 10.0), {"v": "m"})
    assert max(measured(means, "numOutputRows")) < 10_000  # not 400 cells on 400 days
    assert means.where("m = v").count() == 400


def test_links_of_a_cell_are_not_sent_with_each_of_its_days(spark):
    cells = spark.range(120).selectExpr("id as grid_id", "35D + id * 0.0001D as lat", "-120D as lon")
    panel = cells.crossJoin(spark.range(200).selectExpr("cast(id as int) as date")).selectExpr("grid_id", "date", "cast(grid_id + date as double) as v", "'x' as note")
    means = neighbors.radius_mean(panel, cells, spatial.radius_edges(cells, 10.0), {"v": "m"})
    assert sum(measured(means, "dataSize", of="shuffleBytesWritten")) < 12_000_000  # 2,880,000 links and days, of eight bytes at least
    assert means.columns == ["grid_id", "date", "v", "note", "m"] and means.where("abs(m - 59.5 - date) < 1e-9").count() == 24_000


def test_radius_means_of_repeated_and_null_keys(spark):
    """Repeated rows count as often as they come and give one row; rows without a cell or a place have no mean."""
    cells = spark.createDataFrame([(1, 35.0, -120.0), (2, 35.01, -120.0), (3, 38.0, -120.0), (4, None, -120.0), (None, 35.0, -120.0)], "grid_id long, lat double, lon double")
    panel = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (2, 1, 8.0), (2, None, 5.0), (3, 1, None), (4, 1, 1.0), (None, 1, 1.0)], "grid_id long, date int, v double")
    found = neighbors.radius_mean(panel, cells, spatial.radius_edges(cells, 10.0), {"v": "m"}).collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1, 2.0, 4.0), (2, 1, 8.0, 4.0), (2, None, 5.0, 5.0), (3, 1, None, None)]
