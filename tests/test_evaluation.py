import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from terrapanel.operators import distributed, learning, metrics, qa, sampling, trees


def scores(n=3000, seed=1, hot=1000):
    """Random scored rows; a third of them share one score."""
    rng = np.random.default_rng(seed)
    s = np.r_[np.full(hot, 0.5), rng.random(n - hot).round(3)]
    return pd.DataFrame({"score": s, "label": (rng.random(n) < 0.2 + 0.4 * s).astype(int)})


def test_auc_counts_ties_half(spark):
    pdf = scores()
    pos, neg = pdf[pdf.label == 1].score.values, pdf[pdf.label == 0].score.values
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    row = metrics.auc_ap(metrics.score_curve(spark.createDataFrame(pdf))).first()
    assert abs(row.roc_auc - auc) < 1e-12


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_prefix_sums_equal_cumsum(spark, partitions):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"v": rng.permutation(5000).astype(float) ** 3, "n": rng.integers(0, 9, 5000)})
    got = distributed.prefix_sums(spark.createDataFrame(pdf).repartition(partitions), "v", {"c": "n"}).toPandas().sort_values("v")
    assert (got.c.values == pdf.sort_values("v").n.cumsum().values).all()
    down = distributed.prefix_sums(spark.createDataFrame(pdf), "v", {"c": "n"}, descending=True).toPandas().sort_values("v", ascending=False)
    assert (down.c.values == pdf.sort_values("v", ascending=False).n.cumsum().values).all()


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": np.r_[np.zeros(700), rng.normal(size=1300)], "b": rng.integers(0, 5, 2000).astype(float)})
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["name"], r.share): r.value for r in distributed.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], shares).collect()}
    for c in ("a", "b"):
        for s in shares:
            assert abs(got[c, s] - np.quantile(pdf[c], s)) < 1e-12


def test_median_of_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert sampling.medians(df, ["a", "b"]).first() == (2.0, None)


def test_best_threshold_is_the_lowest_best(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)], "score double, label int")
    row = metrics.best_threshold(metrics.score_curve(df)).first()
    assert row.threshold == 0.4 and abs(row.f1 - 1.0) < 1e-8


def test_sweep_marks_first_best(spark):
    df = spark.createDataFrame([(-1.0, 0), (0.5, 1), (0.7, 1)], "score double, label int")
    best = metrics.threshold_sweep(df, [-2.0, -0.5, 0.0, 0.6]).where("is_best").first()
    assert best.threshold == -0.5 and best.f1 == 1.0


def test_split_and_downsample_sizes(spark):
    df = spark.range(10_000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
    parts = {(r.label, r.is_test): r["count"] for r in sampling.stratified_split(df, "label", "id", 0.2).groupBy("label", "is_test").count().collect()}
    assert parts == {(0, True): 1800, (0, False): 7200, (1, True): 200, (1, False): 800}
    kept = {r.label: r["count"] for r in sampling.downsample(df, "label", "id", 3).groupBy("label").count().collect()}
    assert kept == {0: 3000, 1: 1000}
    loose = sampling.stratified_split(df, "label", "id", 0.2, exact=False).where("is_test").count()
    assert 1800 < loose < 2200


def test_standardise_uses_training_moments(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    other = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    scaled = sampling.standardise(train, ["a", "b"], other)
    assert sorted(r.a for r in scaled[0].collect()) == [-1.0, 1.0]
    assert scaled[1].first() == (3.0, 1.0)


def test_feature_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=(250, 3)), np.repeat(rng.normal(size=(1, 3)), 120, axis=0), 20 + 0.01 * rng.normal(size=(80, 3))]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    got = {tuple(r.vec): np.array(r.near) for r in learning.feature_neighbours(df, 5).collect()}
    assert len(got) == len({tuple(v) for v in x})
    for i, v in enumerate(x):
        others = np.delete(x, i, axis=0)
        expected = np.sort(np.linalg.norm(others - v, axis=1))[:5]
        np.testing.assert_allclose(np.linalg.norm(got[tuple(v)] - v, axis=1), expected, atol=1e-12)


def test_smote_balances_between_minority_points(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 1 if i < 30 else 0, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    out = learning.smote(df, "label", "id", ["a", "b"], 5).toPandas()
    assert out.label.value_counts().to_dict() == {0: 270, 1: 270}
    minority = np.array([r[2:] for r in rows if r[1] == 1])
    pairs = [(p, q) for i, p in enumerate(minority) for q in minority[:i]]
    for s in out[out.synthetic][["a", "b"]].to_numpy()[:40]:
        gaps = [np.linalg.norm(s - p) + np.linalg.norm(s - q) - np.linalg.norm(p - q) for p, q in pairs]
        assert min(gaps) < 1e-9


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 4))
    y = (x[:, 0] + x[:, 1] + 0.2 * rng.normal(size=1200) > 1.5).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double, d double").cache()
    return df.where("id % 4 > 0"), df.where("id % 4 = 0")


@pytest.mark.parametrize("name, options", [("gbt", {"maxIter": 10}), ("random_forest", {"numTrees": 20, "maxDepth": 8}), ("svm", {}), ("mlp", {"maxIter": 60})])
def test_learners_find_what_is_there(separable, name, options):
    train, val = separable
    scored = learning.score(learning.fit(train, ["a", "b", "c", "d"], "label", name, **options), val)
    assert metrics.auc_ap(metrics.score_curve(scored)).first().roc_auc > 0.93


def test_a_forest_keeps_the_nodes_of_its_rows(separable):
    """No level walks the rows down the trees again; the trees are those of a forest that does."""
    train, _ = separable
    assert learning.learner("random_forest", 4, "label").getCacheNodeIds()
    kept, walked = (learning.fit(train, list("abcd"), "label", "random_forest", numTrees=5, maxDepth=12, **o).stages[-1].toDebugString for o in ({}, {"cacheNodeIds": False}))
    assert kept.split("\n")[1:] == walked.split("\n")[1:] and len(kept.split("\n")) > 50


def _trees_of(model):
    return re.sub(r"uid=\w+", "", model.stages[-1].toDebugString)


def test_a_tree_of_all_rows_is_sparks(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 20, 900), rng.integers(0, 9, 900), rng.integers(0, 3, 900)], axis=1)
    y = ((x[:, 0] > 7) ^ (x[:, 1] > 3) ^ (rng.random(900) < 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v), 1.0 + 2.0 * int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int, w double").repartition(3)
    whole = {"numTrees": 1, "maxDepth": 6, "bootstrap": False, "featureSubsetStrategy": "all"}
    for weight in (None, "w"):
        spark_own = Pipeline(stages=[VectorAssembler(inputCols=list("abc"), outputCol="features"), learning.learner("random_forest", 3, "label", weight, **whole)]).fit(df)
        found = learning.fit(df, list("abc"), "label", "random_forest", weight, **whole)
        assert _trees_of(found) == _trees_of(spark_own)
        assert np.allclose(found.stages[-1].featureImportances.toArray(), spark_own.stages[-1].featureImportances.toArray())
        mine, theirs = ([r.score for r in learning.score(m, df).orderBy("a", "b", "c").collect()] for m in (found, spark_own))
        assert np.allclose(mine, theirs)


def test_a_forest_is_the_same_however_its_work_is_cut(separable, monkeypatch):
    train, features = separable[0], list("abcd")
    whole = _trees_of(learning.fit(train, features, "label", "random_forest", numTrees=5, maxDepth=6))
    monkeypatch.setattr(trees, "BAG_ROWS", 2 * train.count())  # two trees together
    monkeypatch.setattr(trees, "SUM_CELLS", 6000)  # few nodes to a pass
    assert _trees_of(learning.fit(train, features, "label", "random_forest", numTrees=5, maxDepth=6)) == whole


def test_cut_points_follow_sparks_rule():
    values, counts = np.arange(5.0), np.ones(5)
    assert trees.cut_points(values, counts, 4).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert trees.cut_points(np.arange(100.0), np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    assert trees.cut_points(np.array([3.0]), np.array([9.0]), 31).tolist() == []
    rows = np.random.default_rng(1).normal(size=100_000)
    found, total = trees._counted(rows, np.ones(len(rows)))
    assert len(found) <= trees.SUMMARY and total.sum() == len(rows)


def test_a_forest_of_other_classes_is_left_to_spark(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(60)], "a double, label int")
    assert learning.fit(df, ["a"], "label", "random_forest", numTrees=2, maxDepth=3).stages[-1].numClasses == 3


def test_a_perceptron_weighs_rows_alike_however_they_lie(separable):
    """A task's last, shorter block of rows weighs no more than others: the model is the same for any layout."""
    train, _ = separable
    one, many = (learning.fit(train.repartition(n, "id"), list("abcd"), "label", "mlp", maxIter=15).stages[-1].weights.toArray() for n in (1, 7))
    assert np.abs(one - many).max() < 1e-9


def test_a_perceptron_goes_the_way_of_sparks(separable, tmp_path):
    """In whole blocks of one task Spark weighs rows alike too."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    train, val = separable
    blocks = train.orderBy("id").limit(896).coalesce(1).cache()
    spark_own = Pipeline(stages=[VectorAssembler(inputCols=list("abcd"), outputCol="features"), learning.learner("mlp", 4, "label", maxIter=25)]).fit(blocks)
    found = learning.fit(blocks, list("abcd"), "label", "mlp", maxIter=25)
    assert np.abs(found.stages[-1].weights.toArray() - spark_own.stages[-1].weights.toArray()).max() < 1e-7
    assert found.stages[-1].getMaxIter() == 25 and not found.stages[-1].isSet("initialWeights")
    found.save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(val).count() == 300


@pytest.mark.parametrize("row, message", [((None, 3.0), "no class"), ((2, 3.0), "no class"), ((-1, 3.0), "no class"), ((1, float("inf")), "must be finite")])
def test_a_perceptron_refuses_what_it_cannot_learn(spark, row, message):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), row], "label int, a double")
    with pytest.raises(Exception, match=message):
        learning.fit(df, ["a"], "label", "mlp", maxIter=2)


def test_imbalanced_pipeline_finds_the_telling_features(separable):
    train, val = separable
    found = learning.imbalanced_pipeline(train, val, ["a", "b", "c", "d"], "label", "id", ratio=2, k_best=2, thresholds=[t / 10 for t in range(-20, 21)])
    assert set(found.selected) == {"a", "b"} and [r["rank"] for r in found.importance.collect()] == [1, 2]
    assert found.sweep.where("is_best").first().f1 > 0.75 and found.sweep.count() == 41


def test_selected_features_are_the_telling_ones(separable):
    assert set(learning.select_by_importance(separable[0], ["a", "b", "c", "d"], "label", 2, numTrees=20, maxDepth=6)) == {"a", "b"}


def test_encoded_labels_follow_the_alphabet(spark):
    df = learning.encode_label(spark.createDataFrame([("no",), ("yes",), ("no",)], "y string"), "y", "label")
    assert {(r.y, r.label) for r in df.collect()} == {("no", 0.0), ("yes", 1.0)}


def test_model_and_record_are_written(spark, separable, tmp_path):
    from pyspark.ml import PipelineModel

    from terrapanel.sources import sinks

    train, val = separable
    model = learning.fit(train, ["a", "b"], "label", "svm")
    record = learning.model_record(train, learning.score(model, val), ["a", "b"], "label")
    sinks.write_model(model, record, str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m" / "model")).transform(val).count() == 300
    assert spark.read.json(str(tmp_path / "m" / "threshold")).first().threshold == record.first().best_threshold


def test_qa_report(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "grid_id string")
    labels = spark.createDataFrame([("2023-07-01", "a", 1), ("2023-07-01", "b", 0), ("2023-07-02", "a", 0), ("x", "z", 5)], "date string, grid_id string, fire_today int")
    incidents = spark.createDataFrame([("2023-07-01", "WF", "US-CA")], "date string, type string, state string")
    events = spark.createDataFrame([("2023-07-02", "a")], "date string, grid_id string")
    report, violations = qa.qa_report(labels, cells, incidents, "2023-07-01", "2023-07-02", events)
    found = {(r.section, r.metric): r.value for r in report.collect()}
    assert found["shape", "expected_rows"] == "4" and found["positives", "positives"] == "1"
    assert {k: v.count() for k, v in violations.items()} == {"bad_dates": 1, "bad_values": 1, "missing_grid_ids": 1, "labels_not_in_events": 1}
    missing = qa.missing_cell_days(labels.withColumn("date", F.col("date").try_cast("date")), cells, "2023-07-01", "2023-07-02")
    assert [(r.grid_id, str(r.date)) for r in missing.collect()] == [("b", "2023-07-02")]


def test_published_rates():
    assert 92 * 16_901 == 1_554_892 and 78 / 16_901 == 0.00461511153186202


@pytest.mark.parametrize("rows, fanout", [(25, 4), (60, 16)])
def test_feature_neighbours_down_a_tree_of_balls(spark, monkeypatch, rows, fanout):
    """Balls of any depth: clusters, copies, one line, ties; the same neighbours as all pairs give."""
    monkeypatch.setattr(learning, "MEMBER_ROWS", rows)
    monkeypatch.setattr(learning, "FANOUT", fanout)
    rng = np.random.default_rng(rows)
    x = np.r_[rng.normal(size=(300, 2)), np.repeat(rng.normal(size=(1, 2)), 90, axis=0), 1e6 + 1e-3 * rng.normal(size=(150, 2)), rng.integers(0, 4, (120, 2)).astype(float)]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    got = {tuple(r.vec): np.array(r.near) for r in learning.feature_neighbours(df, 4).collect()}
    assert len(got) == len({tuple(v) for v in x})
    for i, v in enumerate(x):
        others = np.delete(x, i, axis=0)
        gap = np.sqrt(((others - v) ** 2).sum(axis=1))
        expected = others[np.lexsort((others[:, 1], others[:, 0], gap))[:4]]
        np.testing.assert_array_equal(got[tuple(v)], expected)


def test_neighbours_bring_no_rows_to_the_driver(spark, monkeypatch):
    """Flags and sizes only, however many balls there are."""
    monkeypatch.setattr(learning, "MEMBER_ROWS", 20)
    brought = []
    kind = type(spark.range(1))
    whole = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: [brought.append(len(rows := whole(self))), rows][1])
    df = spark.range(2000).selectExpr("array(cast(id % 1999 as double), cast(id * 7 % 1009 as double)) as vec")
    learning.feature_neighbours(df, 3)
    assert brought and max(brought) <= 1


def test_vectors_visit_only_balls_within_their_bound(spark, monkeypatch):
    """Long tails and values that most rows share: the same neighbours as all pairs give, from few balls."""
    monkeypatch.setattr(learning, "MEMBER_ROWS", 60)
    visits = []
    cut = learning.cut_lineage
    monkeypatch.setattr(learning, "cut_lineage", lambda df: [visits.append(df.count()) if {"vid", "vec", "p"} <= set(df.columns) else None, cut(df)][1])
    rng = np.random.default_rng(7)
    x = np.where(rng.random((3000, 4)) < 0.6, 0.0, np.round(np.exp(2 * rng.normal(size=(3000, 4))), 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    got = {tuple(r.vec): np.array(r.near) for r in learning.feature_neighbours(df, 5).collect()}
    assert set(got) == {tuple(v) for v in x} and sum(visits) < 15 * len(got)
    for i in range(0, 3000, 7):
        others = np.delete(x, i, axis=0)
        gap = np.sqrt(((others - x[i]) ** 2).sum(axis=1))
        np.testing.assert_array_equal(got[tuple(x[i])], others[np.lexsort((*others.T[::-1], gap))[:5]])


def test_a_ball_may_hold_nobodys_neighbour(spark, monkeypatch):
    """The last vector is alone in its ball, which gives nothing to anyone."""
    monkeypatch.setattr(learning, "MEMBER_ROWS", 2)
    x = [[float(i), 0.0] for i in range(24)] + [[1e9, 0.0]]
    got = {r.vec[0]: r.near[0][0] for r in learning.feature_neighbours(spark.createDataFrame([(v,) for v in x], "vec array<double>"), 1).collect()}
    assert got == {0.0: 1.0, **{float(i): i - 1.0 for i in range(1, 24)}, 1e9: 23.0}


def test_vectors_with_missing_components_have_no_neighbours(spark):
    rows = [[0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [float("nan"), 0.0], [0.0, None]]
    found = learning.feature_neighbours(spark.createDataFrame([(v,) for v in rows], "vec array<double>"), 1).collect()
    assert sorted((r.vec[0], r.near[0][0]) for r in found) == [(0.0, 1.0), (1.0, 0.0), (3.0, 1.0)]


def test_validation_keeps_the_best_number_of_trees(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + 0.8 * rng.normal(size=1500) > 0.8).astype(int)
    df = spark.createDataFrame([(int(label), *map(float, v)) for label, v in zip(y, x)], "label int, a double, b double, c double")
    train, val = df.limit(500), df.exceptAll(df.limit(500))
    found = learning.fit_validated(train, val, list("abc"), "label", maxIter=25, maxDepth=4, stepSize=0.4)
    assert len(found.losses) == 25 and found.trees == found.losses.index(min(found.losses)) + 1 < 25
    kept = found.model.stages[-1]
    assert kept.getNumTrees == found.trees
    again = kept.evaluateEachIteration(found.model.stages[0].transform(val))
    np.testing.assert_allclose(again, found.losses[: found.trees], rtol=1e-9)
    record = learning.model_record(train, learning.score(found.model, val), list("abc"), "label", found.trees).first()
    assert record.trees == found.trees and record.num_val_rows == 1000
