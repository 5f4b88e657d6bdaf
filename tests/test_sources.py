import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrapanel.functions import columns as C
from terrapanel.operators import cleaning, panel
from terrapanel.operators.polygons import within_polygon
from terrapanel.sources import boundaries, incidents, links, settings, sinks, tabular, tiles


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_column_builders(spark):
    assert one(spark, C.epoch_ms_to_local_text(F.lit(1688256000000))) == "7/1/2023 5:00:00 PM"
    assert one(spark, C.day_of_year_to_date(F.lit(2020), F.lit(153))) == dt.date(2020, 6, 1)
    assert [one(spark, C.half_even(F.lit(v), -3)) for v in (500.0, 1500.0, 2500.0)] == [0, 2000, 2000]
    bins = [one(spark, C.right_closed_bin(F.lit(v), C.CONFIDENCE_EDGES)) for v in (33.0, 66.0, 90.0, 49.999, 50.0, 80.0, -1.0)]
    assert bins == [0, 1, 2, 0, 1, 2, None]
    assert str(one(spark, C.local_window_utc("2023-07-01", "2023-07-01")[0])) == "2023-07-01 07:00:00"
    assert one(spark, C.strip_units(F.lit("1,234.5 m"))) == 1234.5 and one(spark, C.strip_units(F.lit("1e-05"))) is None
    assert [one(spark, C.normalise_confidence(F.lit(v))) for v in ("Low", "nominal", "H", "85", "?")] == [0, 1, 2, 2, 0]
    assert C.class_column_names()["pct_31"] == "pct_Barren_Land_(Rock_Sand_Clay)"


def test_preamble_files_become_factor_rows(spark, tmp_path):
    for tile, lat in ((1, 32.5), (2, 33.0)):
        text = f"-BEGIN HEADER-\nsome words LON\n-END HEADER-\nLAT,LON,YEAR,DOY,T2M\n{lat},-120.0,2020,153,20.5\n{lat},-120.0,2020,154,nan\n"
        (tmp_path / f"T2M_202006_tile{tile}.csv").write_text(text)
    rows = tabular.scan_factors(spark, str(tmp_path)).orderBy("LAT", "DATE").collect()
    assert [(r.factor, r.LAT, str(r.DATE), r.value) for r in rows] == [
        ("T2M", 32.5, "2020-06-01", 20.5), ("T2M", 32.5, "2020-06-02", None), ("T2M", 33.0, "2020-06-01", 20.5), ("T2M", 33.0, "2020-06-02", None),
    ]


def test_later_marker_tokens_come_twice(spark):
    assert one(spark, F.split(tabular.body_lines(F.lit("a b LAT,x\n1  2\tLATER 3 "), "LAT"), "\n")) == ["LAT,x", "1", "2", "LATER", "LATER", "3"]
    assert one(spark, tabular.body_lines(F.lit("no such line PLAT"), "LAT")) is None


def test_elevation_drops_the_units_row_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Longitude , LATITUDE,elev\ndegrees_east,degrees_north,m\n-120.5,38.0,\"1,200 m\"\n-120.4,38.0,n/a\n")
    rows = tabular.scan_elevation(spark, str(tmp_path / "e.csv")).orderBy("longitude").collect()
    assert [(r.longitude, r.latitude, r.elev) for r in rows] == [(-120.5, 38.0, 1200.0), (-120.4, 38.0, None)]


def test_csv_scan_checks_columns(spark, tmp_path):
    (tmp_path / "ndvi_2020_6_9.csv").write_text("date,longitude,latitude,ndvi\n2020-06-01,-120.0,38.0,NaN\n")
    df = tabular.scan_csv(spark, str(tmp_path / "ndvi_????_6_9.csv"), "date date, longitude double, latitude double, ndvi double", required=["ndvi"])
    assert df.first().ndvi is None
    with pytest.raises(ValueError, match="missing columns"):
        cleaning.require_columns(df, ["evi"])


def test_boundary_and_fallback(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    other = [[[10, 10], [11, 10], [11, 11], [10, 10]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"STUSPS": "CA"}, "geometry": {"type": "MultiPolygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"STUSPS": "NV"}, "geometry": {"type": "Polygon", "coordinates": other}},
    ]}
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps(doc))
    rings = boundaries.read_boundary(spark, str(path), [("STUSPS", "CA"), ("STATEFP", "06")])
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 10.6, 10.2), (4, 3.0, 3.0)], "id int, lon double, lat double")
    assert {r.id for r in within_polygon(points, rings).collect()} == {1, 4}
    box = boundaries.read_boundary(spark, str(tmp_path / "none.geojson"), bbox=(1, 1, 2, 2))
    assert {r.id for r in within_polygon(points, box).collect()} == {2}


def test_incident_features_and_settings(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"IrwinID": "a", "FireDiscoveryDateTime": 1688256000000, "ControlDateTime": "text"}}]}))
    row = incidents.format_dates(incidents.scan_features(spark, str(tmp_path / "p.json"))).first()
    assert (row.FireDiscoveryDateTime, row.ControlDateTime) == ("7/1/2023 5:00:00 PM", "text")
    doc = {"time_period": {"start_date": "2023-07-01", "end_date": "2023-09-30"}, "spatial_extent": {"min_longitude": -125.0, "max_longitude": -113.0, "min_latitude": 32.0, "max_latitude": 42.5}, "grid": {"resolution_km": 5}}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    read = settings.read_settings(spark, str(tmp_path / "s.json"))
    assert read.bbox == (-125.0, 32.0, -113.0, 42.5) and read.start_date == "2023-07-01"


def test_keep_first_collapses_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("x", 3, "c"), ("x", 4, "d")], "k string, o int, v string")
    assert sorted((r.k or "", r.o, r.v) for r in cleaning.keep_first(df, ["k"], ["o"]).collect()) == [("", 1, "a"), ("x", 3, "c")]


def test_tile_rows_and_dates(spark):
    tile = [("LAND_v001_20230705_c.nc", {"scale_factor": "0.5", "_FillValue": "-9"}, [39.0, 38.0], [-120.0, -119.0, -118.0], [1, 2, 3, -9, 5, 6])]
    df = spark.createDataFrame(tile, "file string, attrs map<string,string>, lat array<double>, lon array<double>, raw array<int>")
    rows = tiles.tiles_to_rows(df, bbox=(-120, 38, -119, 39)).orderBy("latitude", "longitude").collect()
    assert [(str(r.date), r.latitude, r.longitude, r.ndvi) for r in rows] == [
        ("2023-07-05", 38.0, -120.0, None), ("2023-07-05", 38.0, -119.0, 2.5), ("2023-07-05", 39.0, -120.0, 0.5), ("2023-07-05", 39.0, -119.0, 1.0),
    ]


@pytest.mark.parametrize(
    "page, link, expected",
    [
        ("http://h.org/a/b.html?x=1", "c.nc", "http://h.org/a/c.nc"),
        ("http://h.org", "c.nc", "http://h.org/c.nc"),
        ("http://h.org/a/", "/c.nc", "http://h.org/c.nc"),
        ("https://h.org/a", "//i.org/c.nc", "https://i.org/c.nc"),
        ("https://h.org/a", "ftp://i.org/c.nc", "ftp://i.org/c.nc"),
        ("http://h/a/b/c?q#f", "../x.nc", "http://h/a/x.nc"),
        ("http://h/a/b/c", "./x.nc", "http://h/a/b/x.nc"),
        ("http://h/a/b/c", "../../../x/../y.nc", "http://h/y.nc"),
        ("http://h/a/b/c", "..", "http://h/a/"),
        ("http://h/a/b/c", ".", "http://h/a/b/"),
        ("http://h/a/b?x=1", "?C=N", "http://h/a/b?C=N"),
        ("http://h/a/b?x=1", "#top", "http://h/a/b?x=1#top"),
        ("http://h", "x?y=/../z", "http://h/x?y=/../z"),
    ],
)
def test_links_resolve(spark, page, link, expected):
    assert one(spark, links.absolute_url(F.lit(page), F.lit(link))) == expected


def test_links_are_harvested_as_the_index_names_them(spark):
    html = """<a href="x.NC">1</a><A class=q HREF = y.nc>2</A><a href='/z.nc'>3</a><link href="no.nc"><a name=k>4</a><a href="http://i/w.nc">5</a><a href="v.nc?x">6</a><a href="s.nc">7</a>"""
    pages = spark.createDataFrame([("http://h/a/", html), ("http://h/a", '<a href="s.nc">7</a>')], "url string, html string")
    found = sorted(r.url for r in links.harvest_links(pages).collect())
    assert found == ["http://h/a/s.nc", "http://h/a/x.NC", "http://h/a/y.nc", "http://h/a/z.nc", "http://i/w.nc"]
    by_standard = sorted(r.url for r in links.harvest_links(pages, resolve=links.absolute_url).collect())
    assert by_standard == ["http://h/a/s.nc", "http://h/a/x.NC", "http://h/a/y.nc", "http://h/s.nc", "http://h/z.nc", "http://i/w.nc"]


def test_joined_and_stacked_factor_merges_agree(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    long = a.selectExpr("k", "'a' as f", "a as v").union(b.selectExpr("k", "'b' as f", "b as v"))
    for how in ("inner", "outer"):
        joined = panel.join_factors([a, b], ["k"], how).orderBy("k").collect()
        assert joined == panel.merge_factors(long, ["k"], "f", "v", ["a", "b"], how).orderBy("k").collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 6, 1), 1.5), (dt.date(2021, 6, 1), None)], "date date, v double")
    sinks.write_by_year(df, str(tmp_path / "y"))
    assert sorted(r.year for r in spark.read.parquet(str(tmp_path / "y")).collect()) == [2020, 2021]
    sinks.write_by_day(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    sinks.write_table(df, str(tmp_path / "t.csv"))
    assert any("NaN" in r.value for r in spark.read.text(str(tmp_path / "t.csv")).collect())
    sinks.write_table(df, str(tmp_path / "t"), small=True)
    assert dict(spark.read.parquet(str(tmp_path / "t")).dtypes)["v"] == "float"
    tabular.parquet_to_csv(spark, str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    cells = spark.createDataFrame([("a", 0.5, 0.5)], "grid_id string, lon double, lat double")
    sinks.write_grid(cells, spark.createDataFrame([("a", ring)], "grid_id string, ring array<struct<x: double, y: double>>"), str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g" / "features")).first().value)
    assert feature["geometry"]["coordinates"][0][1] == [1.0, 0.0]
    assert sinks.write_report(cells, {"none": cells.where("false"), "some": cells}, str(tmp_path / "r")) == ["some"]


def test_windows_leave_the_rest_of_a_tile_alone(spark):
    """Axes that run either way, turn back, miss the window or are empty; pixels outside never become rows."""
    lat, lon = [40.0 - 0.5 * i for i in range(20)], [-125.0 + 0.25 * i for i in range(30)]
    raw = list(range(600))
    box = (-122.6, 34.9, -120.4, 37.1)
    axes = {"down": (lat, lon), "up": (lat[::-1], lon), "west": (lat, lon[::-1]), "miss": ([l + 30 for l in lat], lon), "turns": (lat, lon[:15] + lon[:15])}
    rows = [(f"{n}_20230705_", {"scale_factor": "2", "valid_range": "[0, 500]", "valid_max": "450", "missing_value": "99"}, a, b, raw) for n, (a, b) in axes.items()]
    rows += [("none_20230705_", {}, [], [], []), ("short_20230705_", {}, [36.0], [-122.0], [7])]
    df = spark.createDataFrame(rows, "file string, attrs map<string,string>, lat array<double>, lon array<double>, raw array<int>")
    got = sorted((r.longitude, r.latitude, r.ndvi is None, r.ndvi or 0.0) for r in tiles.tiles_to_rows(df, bbox=box).collect())
    want = []
    for _, attrs, a, b, values in rows:
        for k, v in enumerate(values):
            x, y = b[k % len(b)], a[k // len(b)]
            if box[0] <= x <= box[2] and box[1] <= y <= box[3]:
                bad = bool(attrs) and (v > 450 or v == 99)
                want.append((x, y, bad, 0.0 if bad else v * (2.0 if attrs else 1.0)))
    assert got == sorted(want)
    monotone = df.where("file not like 'turns%'")
    lines = tiles.window_lines(monotone, box)
    assert lines.agg(F.sum(F.size("line"))).first()[0] == tiles.tiles_to_rows(monotone, bbox=box).count()
    assert tiles.tiles_to_rows(df).count() == 3001
    # Attributes are parsed below the explosion of lines, once a tile.
    plan = tiles.tiles_to_rows(df, bbox=box)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last_generate = max(n for n, line in enumerate(plan) if "Generate" in line)
    assert all(n > last_generate for n, line in enumerate(plan) if "valid_range" in line)


def test_files_without_a_key_align_by_position(spark, tmp_path):
    """Whatever the split size, the number of files, and what else stands in them."""
    n = 3000
    for name, column, parts in (("x", "cast(id * 2 as double) as a, 'q' as q", 4), ("y", "id % 7 as label", 3)):
        frame = spark.range(n).repartitionByRange(parts, "id").sortWithinPartitions("id")
        frame.selectExpr(*column.split(", ")).write.option("header", True).csv(str(tmp_path / name))
    for size in ("64m", "1k", "333b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            left = spark.read.schema("a double, q string").option("header", True).csv(str(tmp_path / "x"))
            right = spark.read.schema("label long").option("header", True).csv(str(tmp_path / "y"))
            rows = tabular.align_by_position(left, right).collect()
            assert sorted((r.position, r.a, r.q, r.label) for r in rows) == [(i, 2.0 * i, "q", i % 7) for i in range(n)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError, match="rows on one side"):
        tabular.align_by_position(left, spark.read.schema("label long").option("header", True).csv(str(tmp_path / "y" / "part-00000*")))
    with pytest.raises(ValueError, match="both sides"):
        tabular.align_by_position(left, left)
