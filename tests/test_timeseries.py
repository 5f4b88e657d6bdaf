import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import timeseries as ts
from terrapanel.operators.panel import keep_covered

DAY = dt.date(2023, 7, 1)


def frame(spark, values, days=None):
    days = days or range(len(values))
    rows = [("a", DAY + dt.timedelta(days=d), None if v is None else float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "k string, date date, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


_ = None


def test_linear_fill_extends_both_ends(spark):
    df = ts.fill_linear(frame(spark, [_, _, 1, _, _, 4, _, _]), "k", "date", "v")
    assert column(df, "v") == [1, 1, 1, 2, 3, 4, 4, 4]


@pytest.mark.parametrize(
    "values, days, expected",
    [
        ([_, _, _, 1, _, _, _, _, _, 7, _, _, _, _], None, [_, 1, 1, 1, 2, 3, _, 5, 6, 7, 7, 7, _, _]),
        ([1, _, _, _, _, 6], None, [1, 2, 3, 4, 5, 6]),
        ([0, _, 10], [0, 1, 10], [0, 1, 10]),
        ([_, _, _], None, [_, _, _]),
    ],
)
def test_time_fill_reaches_two_rows(spark, values, days, expected):
    assert column(ts.fill_time(frame(spark, values, days), "k", "date", "v", "o", 2), "o") == expected


def test_time_fill_equals_pandas(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        days = np.sort(rng.choice(60, 25, replace=False))
        rows += [(k, DAY + dt.timedelta(days=int(d)), None if rng.random() < 0.5 else float(rng.normal())) for d in days]
    df = spark.createDataFrame(rows, "k int, date date, v double")
    got = ts.fill_time(df, "k", "date", "v", "o", 2).toPandas().sort_values(["k", "date"])
    pdf = pd.DataFrame(rows, columns=["k", "date", "v"])
    pdf["date"] = pd.to_datetime(pdf["date"])
    expected = [g.set_index("date")["v"].astype(float).interpolate(method="time", limit=2, limit_direction="both") for _k, g in pdf.groupby("k")]
    np.testing.assert_allclose(got["o"].to_numpy(float), pd.concat(expected).to_numpy(), atol=1e-12)


def test_rolling_rows_need_full_known_frames(spark):
    df = ts.rolling_rows(frame(spark, [1, 2, _, 4, 5, 6]), "k", "date", [("v", 3, "mean", "m"), ("v", 3, "sum", "s")])
    assert column(df, "m") == [_, _, _, _, _, 5]
    assert column(df, "s") == [_, _, _, _, _, 15]


def test_rolling_days_count_known_days(spark):
    df = ts.rolling_days(frame(spark, range(1, 11)), "k", "date", [("v", 7, 3, "m")])
    assert column(df, "m") == [_, _, 2, 2.5, 3, 3.5, 4, 5, 6, 7]


def test_streak_restarts(spark):
    df = ts.missing_streak(frame(spark, [_, _, 1, _, _, _]), "k", "date", "v", "f", "s")
    assert column(df, "f") == [1, 1, 0, 1, 1, 1]
    assert column(df, "s") == [1, 2, 0, 1, 2, 3]


def test_history_with_and_without_today(spark):
    df = frame(spark, [1, 0, 1, 1, 0])
    assert column(ts.event_history(df, "k", "date", "v", {"h": 2}), "h") == [0, 1, 1, 2, 1]
    assert column(ts.event_history(df, "k", "date", "v", {"h": 2}, include_current=False), "h") == [0, 0, 1, 1, 2]


def test_nearest_fill_stays_inside_and_prefers_the_lower_side(spark):
    df = ts.fill_nearest_along(frame(spark, [_, 1, _, _, _, 5, _]).selectExpr("k", "date", "v", "cast(unix_date(date) as double) as x"), "k", "x", "v", "o")
    assert column(df, "o") == [_, 1, 1, 1, 5, 5, _]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_result_does_not_depend_on_partitions(spark, partitions):
    df = frame(spark, [_, 1, _, _, 4, _, 2]).repartition(partitions)
    assert column(ts.vegetation_features(df.withColumnRenamed("v", "ndvi"), ["k"]), "ndvi_interp") == [1, 1, 2, 3, 4, 3, 2]


def test_keep_covered_needs_every_column(spark):
    rows = [("a", 1, 1.0, None), ("a", 2, None, 2.0), ("b", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, d int, x double, y double")
    assert {r.k for r in keep_covered(df, "k", ["x", "y"]).collect()} == {"a"}


def long_frames(spark):
    """One key with a third of all rows, uneven days, NULL keys, values that are missing for longer than a block."""
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 300), ("b", 290), (None, 150), ("c", 150), ("d", 3), ("e", 1)):
        days = np.cumsum(rng.integers(1, 4, n))
        for k, d in enumerate(days):
            missing = rng.random() < 0.4 or 40 <= k < 75 or (key == "d")
            rows.append((key, DAY + dt.timedelta(days=int(d)), None if missing else float(rng.normal()), int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "k string, date date, v double, hit int")


@pytest.mark.parametrize("block_rows", [21, 64, 1000])
def test_blocks_change_nothing(spark, block_rows):
    df = long_frames(spark)
    makers = {
        "linear": lambda d, **o: ts.fill_linear(d, "k", "date", "v", "o", **o),
        "time": lambda d, **o: ts.fill_time(d, ["k"], "date", "v", "o", 2, **o),
        "interior": lambda d, **o: ts.fill_time(d, "k", "date", "v", "o", None, False, **o),
        "rows": lambda d, **o: ts.rolling_rows(d, "k", "date", [("v", 3, "mean", "o"), ("hit", 7, "sum", "p")], **o),
        "history": lambda d, **o: ts.event_history(d, "k", "date", "hit", {"o": 7, "p": 14}, **o),
        "before": lambda d, **o: ts.event_history(d, "k", "date", "hit", {"o": 14}, False, **o),
        "days": lambda d, **o: ts.rolling_days(d, "k", "date", [("v", 7, 3, "o"), ("v", 21, 2, "p")], **o),
        "streak": lambda d, **o: ts.missing_streak(d, "k", "date", "v", "o", "p", **o),
        "nearest": lambda d, **o: ts.fill_nearest_along(d.withColumn("x", F.unix_date("date").cast("double")), "k", "x", "v", "o", **o),
        "all": lambda d, **o: ts.vegetation_features(d.withColumnRenamed("v", "ndvi"), ["k"], **o),
    }
    for name, make in makers.items():
        whole, cut = (make(df, **o).toPandas().sort_values(["k", "date"], ignore_index=True) for o in ({}, {"block_rows": block_rows}))
        pd.testing.assert_frame_equal(cut[whole.columns], whole, rtol=1e-9, obj=name)


def test_blocks_are_balanced(spark):
    """A key with a third of all rows is cut into blocks of at most the asked size, also in the numbering."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 1000 as string)) as k", "cast(id as double) as x", "if(id % 5 = 0, null, cast(id as double)) as v")
    rows, keys = ts._blocks(df, "k", "x", 6, 500)
    assert rows.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 506
    assert rows.where("not _guest").count() == 30_000
    with pytest.raises(ValueError):
        ts.rolling_rows(df, "k", "x", [("v", 600, "mean", "m")], block_rows=500)


def test_a_cube_is_written_by_many_tasks(spark, capsys):
    """Longitudes are dealt out by number, which is kept however few bytes they are, before days and latitudes are generated."""
    df = spark.range(400).selectExpr("date_add(date'2023-07-01', cast(id % 5 as int)) as date", "cast(id % 4 as double) as latitude", "cast(id div 4 as double) as longitude", "cast(id as double) as ndvi")
    cube = ts.densify_cube(df)
    cube.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert cube.count() == 5 * 4 * 100 and cube.where("ndvi is not null").count() == 400
