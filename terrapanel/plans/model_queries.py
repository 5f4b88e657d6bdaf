"""Splits, sampling, scaling, evaluation and learners."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapanel.functions.columns import with_interactions
from terrapanel.operators import learning, metrics, sampling
from terrapanel.operators.distributed import exact_quantiles
from terrapanel.operators.panel import build_panel, cell_day_mean, densify, merge_factors
from terrapanel.operators.timeseries import event_history, rolling_rows
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.roles import WEATHER, table
from terrapanel.session import cut_lineage, ensure_checkpoint_dir
from terrapanel.sources.sinks import write_model


def _orders(spark, sf_dir):
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), urgent.alias("label"))


_ORDERS = "o as (select o_orderkey, cast(o_orderdate as date) as date, cast(o_orderpriority = '1-URGENT' as integer) as label from orders)"


@register("temporal_split", "o_orderkey:l part:s", f"with {_ORDERS} select o_orderkey, case when date < date '1999-01-01' then 'train' else 'val' end as part from o")
def temporal_split(spark, sf_dir):
    train, val = sampling.temporal_split(_orders(spark, sf_dir), "1999-01-01")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(val.select("o_orderkey", F.lit("val").alias("part")))


@register(
    "stratified_split",
    "o_orderkey:l label:l is_test:b",
    f"""with {_ORDERS}, r as (select *, row_number() over (partition by label order by md5(o_orderkey || '|42'), o_orderkey) as rn, count(*) over (partition by label) as n from o)
    select o_orderkey, label, rn <= floor(n * 0.2e0 + 0.5e0) as is_test from r""",
)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_orders(spark, sf_dir), "label", "o_orderkey", 0.2, 42)


@register(
    "downsample",
    "o_orderkey:l label:l",
    f"""with {_ORDERS}, r as (select *, row_number() over (partition by label order by md5(o_orderkey || '|7'), o_orderkey) as rn, (select sum(label) from o) as pos from o)
    select o_orderkey, label from r where label = 1 or rn <= 2 * pos""",
)
def downsample(spark, sf_dir):
    return sampling.downsample(_orders(spark, sf_dir), "label", "o_orderkey", 2, 7)


@register(
    "class_weights",
    "n_pos:l n_neg:l scale_pos_weight:f9 weight_neg:f9 weight_pos:f9",
    f"with {_ORDERS}, c as (select count(*) as n, sum(label) as p from o) select p as n_pos, n - p as n_neg, (n - p) / cast(p as double) as scale_pos_weight, n / (2e0 * (n - p)) as weight_neg, n / (2e0 * p) as weight_pos from c",
)
def class_weights(spark, sf_dir):
    return sampling.class_balance(_orders(spark, sf_dir))


_GAPS = """li as (select l_orderkey, l_linenumber, l_partkey, cast(l_shipdate as date) as date, case when l_linenumber <> 3 then l_quantity end as quantity, case when l_discount > 0.03e0 then l_extendedprice end as price from lineitem)"""


def _gappy(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).alias("price"),
    )


@register(
    "impute_median",
    "l_orderkey:l l_linenumber:l l_partkey:l part:s quantity:f6 price:f6",
    f"""with {_GAPS}, m as (select median(quantity) as mq, median(price) as mp from li where date < date '1999-01-01')
    select l_orderkey, l_linenumber, l_partkey, case when date < date '1999-01-01' then 'train' else 'val' end as part, coalesce(quantity, mq) as quantity, coalesce(price, mp) as price from li cross join m""",
)
def impute_median(spark, sf_dir):
    train, val = sampling.temporal_split(_gappy(spark, sf_dir), "1999-01-01")
    train, val = sampling.impute_median(train, ["quantity", "price"], val)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@register(
    "exact_quantiles",
    "name:s share:f3 value:f6",
    f"with {_GAPS} "
    + " union all ".join(f"select '{c}' as name, {s}e0 as share, quantile_cont({c}, {s}) as value from li" for c in ("quantity", "price") for s in (0.01, 0.25, 0.5, 0.9, 0.999)),
)
def exact_quantiles_query(spark, sf_dir):
    return exact_quantiles(_gappy(spark, sf_dir), ["quantity", "price"], [0.01, 0.25, 0.5, 0.9, 0.999])


@register(
    "standardize",
    "l_orderkey:l l_linenumber:l l_partkey:l quantity:f6 price:f6",
    f"""with {_GAPS}, m as (select avg(quantity) as a, stddev_pop(quantity) as b, avg(price) as c, stddev_pop(price) as d from li)
    select l_orderkey, l_linenumber, l_partkey, (quantity - a) / b as quantity, (price - c) / d as price from li cross join m""",
)
def standardize(spark, sf_dir):
    return sampling.standardise(_gappy(spark, sf_dir), ["quantity", "price"])[0]


_MI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _mi_sql(c: str) -> str:
    return f"""select '{c}' as feature, sum(j.n / cast(t.n as double) * ln(j.n * cast(t.n as double) / (b.n * y.n))) as mi from
      (select slot_{c} as s, label, count(*) as n from binned group by 1, 2) j join (select slot_{c} as s, count(*) as n from binned group by 1) b on b.s = j.s
      join (select label, count(*) as n from binned group by 1) y on y.label = j.label cross join (select count(*) as n from binned) t"""


@register(
    "mi_select",
    "feature:s mi:f9",
    "with lim as (select " + ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _MI_COLS) + " from lineitem), binned as (select cast(l_returnflag = 'R' as integer) as label, "
    + ", ".join(f"least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10), 9) as slot_{c}" for c in _MI_COLS) + " from lineitem cross join lim) select * from (" + " union all ".join(_mi_sql(c) for c in _MI_COLS) + ") order by mi desc, feature limit 3",
)
def mi_select(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return sampling.select_k_best(sampling.mutual_information(items, _MI_COLS, "label", 10), 3)


def _mi_near_sql(c: str) -> str:
    """Gaps to the third nearest row of the class, from the values around; counts between both ends by running sums."""
    around = ", ".join(f"{way}(struct_pack(v := v, n := n), {s}) over w" for way in ("lag", "lead") for s in (1, 2, 3))
    return f"""select '{c}' as feature, greatest(0, any_value(dn.g) + sum(q.n * (dk.g - ds.g - dm.g)) / sum(q.n)) as mi from (
      select a.y, a.v, a.n, a.size, a.k, a.d, case when a.d = 0 then (select t.n from tot_{c} t where t.v = a.v) else hi.upto - coalesce(lo.upto, 0) end as m
      from (select *, list_sort(flatten(list_transform(list_filter(near, lambda x: x is not null), lambda x: list_transform(range(least(x.n, 3)), lambda z: abs(x.v - v)))) || list_transform(range(least(n - 1, 3)), lambda z: 0e0))[k] as d
        from (select y, v, n, size, cast(least(3, size - 1) as bigint) as k, [{around}] as near from val_{c} window w as (partition by y order by v))) a
      asof left join cum_{c} hi on a.v + a.d > hi.v asof left join cum_{c} lo on a.v - a.d >= lo.v) q
      join harm dk on dk.n = q.k join harm ds on ds.n = q.size join harm dm on dm.n = q.m join harm dn on dn.n = (select sum(n) from val_{c})"""


def _mi_near_tables(c: str) -> str:
    return f"""val_{c} as (select *, sum(n) over (partition by y) as size from (select label as y, cast({c} as double) as v, count(*) as n from li group by 1, 2)),
      tot_{c} as (select v, sum(n) as n from val_{c} group by 1), cum_{c} as (select v, sum(n) over (order by v) as upto from tot_{c})"""


@register(
    "mi_knn",
    "rank:l feature:s mi:f6",
    "with li as (select cast(l_returnflag = 'R' as integer) as label, * from lineitem), "
    + "harm as (select n, coalesce(sum(1e0 / (n - 1)) over (order by n rows between unbounded preceding and current row), 0) - 0.57721566490153286e0 as g from (select unnest(generate_series(1, (select count(*) from lineitem))) as n) where n > 1 union all select 1, -0.57721566490153286e0), "
    + ", ".join(_mi_near_tables(c) for c in _MI_COLS) + " select row_number() over (order by mi desc, feature) as rank, * from (" + " union all ".join(_mi_near_sql(c) for c in _MI_COLS) + ")",
)
def mi_knn(spark, sf_dir):
    """Features by mutual information from nearest neighbours, best first."""
    items = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    scores = sampling.mutual_information_neighbours(items, _MI_COLS, "label", 3)
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mi").desc(), "feature")))  # one row per feature


# Evaluation.

_CURVE = f"""{roles.SCORED}, g as (select score, count(*) as n, sum(label) as p from scored group by 1),
curve as (select *, sum(p) over (order by score desc) as tp, sum(n - p) over (order by score desc) as fp, (select sum(label) from scored) as pos, (select count(*) - sum(label) from scored) as neg from g)"""
_PR = "pr as (select score as threshold, tp / cast(tp + fp as double) as precision, tp / cast(pos as double) as recall from curve)"
_F1 = "f as (select *, 2 * (precision * recall) / (precision + recall + 1e-9) as f1 from pr)"


def _curve(spark, sf_dir):
    return metrics.score_curve(roles.scored(spark, sf_dir))


@register(
    "roc_auc_ap",
    "roc_auc:f9 avg_precision:f9",
    f"""with {_CURVE} select (select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) / count(*) from (select score from scored where label = 1) a cross join (select score from scored where label = 0) b) as roc_auc,
    (select sum((tp - lag_tp) / cast(pos as double) * (tp / cast(tp + fp as double))) from (select *, coalesce(lag(tp) over (order by score desc), 0) as lag_tp from curve)) as avg_precision""",
)
def roc_auc_ap(spark, sf_dir):
    return metrics.auc_ap(_curve(spark, sf_dir))


@register("pr_curve", "threshold:f6 precision:f9 recall:f9", f"with {_CURVE}, {_PR} select * from pr union all select null, 1, 0")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(_curve(spark, sf_dir))


@register("best_threshold", "threshold:f6 f1:f9 precision:f9 recall:f9", f"with {_CURVE}, {_PR}, {_F1} select * from f order by f1 desc, threshold limit 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_curve(spark, sf_dir))


_STEPS = [float(t) for t in range(-2, 200, 3)]
_SWEEP = f"""{roles.SCORED}, t as (select unnest([{', '.join(f'{s}e0' for s in _STEPS)}]) as threshold),
s as (select threshold, count(*) filter (where score >= threshold and label = 1) as tp, count(*) filter (where score >= threshold and label = 0) as fp, count(*) filter (where score < threshold and label = 1) as fn from scored cross join t group by 1),
r as (select *, case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end as precision, case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end as recall, case when 2 * tp + fp + fn = 0 then 0 else 2e0 * tp / (2 * tp + fp + fn) end as f1 from s)"""


@register("threshold_sweep", "threshold:f6 tp:l fp:l fn:l precision:f9 recall:f9 f1:f9 is_best:b", f"with {_SWEEP} select *, row_number() over (order by f1 desc, threshold) = 1 as is_best from r")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(roles.scored(spark, sf_dir), _STEPS)


_PRED = f"{roles.SCORED}, p as (select label, cast(score >= 10 as integer) as pred from scored)"


def _predicted(spark, sf_dir):
    return metrics.with_prediction(roles.scored(spark, sf_dir), 10.0)


@register(
    "confusion",
    "label:l pred:l n:l",
    f"with {_PRED} select a.v as label, b.v as pred, (select count(*) from p where p.label = a.v and p.pred = b.v) as n from (values (0), (1)) a(v) cross join (values (0), (1)) b(v)",
)
def confusion(spark, sf_dir):
    return metrics.confusion(_predicted(spark, sf_dir))


@register(
    "class_report",
    "class:s precision:f9 recall:f9 f1:f9 support:l",
    f"""with {_PRED}, c as (select v as class, (select count(*) from p where label = v and pred = v) as hit, (select count(*) from p where label = v) as sup, (select count(*) from p where pred = v) as pre from (values (0), (1)) t(v)),
    m as (select class, coalesce(hit / nullif(cast(pre as double), 0), 0) as precision, coalesce(hit / nullif(cast(sup as double), 0), 0) as recall, coalesce(2e0 * hit / nullif(pre + sup, 0), 0) as f1, sup as support from c)
    select cast(class as varchar) as class, precision, recall, f1, support from m union all select 'accuracy', a, a, a, n from (select avg(cast(label = pred as integer)) as a, count(*) as n from p)
    union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from m
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m""",
)
def class_report(spark, sf_dir):
    return metrics.class_report(_predicted(spark, sf_dir))


# Learners on the readings: is a series above its usual level of errors today?
#
# What a learner finds is its own; its queries return what is determined whatever it finds:
# the rows it was given, their classes and weights, the rows it scored, and whether the
# figures derived from its scores are the exact ones.

_FEATURES = ["T2M", "RH2M", "WS10M", "PRECTOTCORR", "T2M_3d_mean", "fires_last_7d", "vpd_proxy", "hot_windy", "dry_windy"]
_CUT = "2024-01-23"


def _unfilled_frame(spark, sf_dir):
    """(key, date, features, label): dense readings of every site with their gaps, materialised."""
    obs = roles.observations(spark, sf_dir)
    wide = merge_factors(cell_day_mean(obs, ["grid_id", "date", "factor"], ["value"]), ["grid_id", "date"], "factor", "value", WEATHER, how="outer")
    cells = obs.select("grid_id").distinct()
    panel = build_panel(densify(cells, *roles.calendar_span(spark, sf_dir)), [wide])
    panel = panel.withColumn("fire_today", F.coalesce((F.col("PS") > 60).cast("int"), F.lit(0)))
    panel = rolling_rows(panel, "grid_id", "date", [("T2M", 3, "mean", "T2M_3d_mean")])
    panel = event_history(panel, "grid_id", "date", "fire_today", {"fires_last_7d": 7}, include_current=False)
    panel = with_interactions(panel.withColumn("ndvi", F.col("WS10M") / 500.0))
    panel = panel.withColumns({"key": F.concat_ws("|", "grid_id", "date"), "label": F.col("fire_today")})
    return cut_lineage(panel.select("key", "date", "label", *_FEATURES))


def _learning_frame(spark, sf_dir):
    """Training and validation rows, gaps imputed and scaled by the training days."""
    train, val = sampling.temporal_split(_unfilled_frame(spark, sf_dir), _CUT)
    filled = sampling.impute_median(train, _FEATURES, val)
    zeroed = [f.na.fill(0.0, _FEATURES) for f in filled]  # a feature without any training value
    return sampling.standardise(zeroed[0], _FEATURES, zeroed[1])


_LEARNT = f"""{roles.OBS}, {roles.CALENDAR}, ps as (select grid_id, date, avg(value) as v from obs where factor = 'PS' group by 1, 2),
frame as (select c.grid_id, d.date, cast(coalesce(p.v, 0) > 60 as integer) as label from (select distinct grid_id from obs) c cross join days d left join ps p on p.grid_id = c.grid_id and p.date = d.date),
tr as (select * from frame where date < date '{_CUT}'), va as (select * from frame where date >= date '{_CUT}'),
sizes as (select (select count(*) from tr) as n, (select sum(label) from tr) as p, (select count(*) from va) as vn, (select sum(label) from va) as vp)"""
_RECORD = "num_train_rows:l num_val_rows:l train_fire_cases:l val_fire_cases:l scale_pos_weight:f6 weight_neg:f6 weight_pos:f6 scored_rows:l auc_is_exact:b threshold_is_best:b"


def _record_sql(weights: str) -> str:
    neg, pos = {"none": ("1", "1"), "ratio": ("1", "(n - p) / cast(p as double)"), "balanced": ("n / (2e0 * (n - p))", "n / (2e0 * p)")}[weights]
    return f"""with {_LEARNT} select n as num_train_rows, vn as num_val_rows, p as train_fire_cases, vp as val_fire_cases, (n - p) / cast(p as double) as scale_pos_weight,
    {neg} as weight_neg, {pos} as weight_pos, vn as scored_rows, true as auc_is_exact, true as threshold_is_best from sizes"""


def _record(spark, sf_dir, name, weights="none", **options):
    """Fit on the first days, score the last ones, and describe the result."""
    train, val = (f.select("key", "label", *_FEATURES) for f in _learning_frame(spark, sf_dir))
    weighted = train.withColumn("weight", F.lit(1.0)) if weights == "none" else sampling.with_class_weight(train, "label", balanced=weights == "balanced")
    model = learning.fit(weighted, _FEATURES, "label", name, None if weights == "none" else "weight", **options)
    scored = cut_lineage(learning.score(model, val).select("key", "label", "score"))
    found = learning.model_record(train, scored, _FEATURES, "label")
    best = found.first()
    # The same figures by other means: Spark's evaluator, and counts at the threshold and at those around it.
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0).evaluate(scored)
    others = scored.approxQuantile("score", [i / 50 for i in range(51)], 0.001)

    def f1(at: float):
        hit, said, true = (F.sum(c.cast("double")) for c in ((F.col("score") >= at) & (F.col("label") == 1), F.col("score") >= at, F.col("label") == 1))
        return 2 * hit / (said + true + 1e-9)

    reached = scored.agg(F.count("*"), f1(best.best_threshold), F.greatest(*[F.coalesce(f1(t), F.lit(0.0)) for t in others])).first()
    used = {r["label"]: r["w"] for r in weighted.groupBy("label").agg(F.max("weight").alias("w")).collect()}  # one row per class
    return found.withColumns(
        {
            "weight_neg": F.lit(used[0]), "weight_pos": F.lit(used[1]), "scored_rows": F.lit(reached[0]),
            "auc_is_exact": F.abs(F.col("roc_auc") - area) < 1e-9, "threshold_is_best": F.lit(reached[1] >= reached[2] - 1e-6),
        }
    )


@register("gbt_fit", _RECORD, _record_sql("ratio"))
def gbt_fit(spark, sf_dir):
    """500 trees of depth 6."""
    return _record(spark, sf_dir, "gbt", "ratio")


@register("rf_fit", _RECORD, _record_sql("balanced"))
def rf_fit(spark, sf_dir):
    """300 trees of any depth Spark allows, four rows a leaf."""
    return _record(spark, sf_dir, "random_forest", "balanced")


@register("svm_fit", _RECORD, _record_sql("balanced"))
def svm_fit(spark, sf_dir):
    return _record(spark, sf_dir, "svm", "balanced")


@register("mlp_fit", _RECORD, _record_sql("none"))
def mlp_fit(spark, sf_dir):
    """Hidden layers of 128 and 64."""
    return _record(spark, sf_dir, "mlp")


_RANKED = "rank:l features:l importance_falls:b"


def _ranking(found):
    """One row per rank: whether importance falls from rank to rank, and how many features were ranked."""
    before = F.lag("importance").over(Window.orderBy("rank"))  # one row per feature
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    return found.select("rank", count.alias("features"), F.coalesce(before >= F.col("importance"), F.lit(True)).alias("importance_falls"))


@register("feature_importance", _RANKED, f"select unnest(generate_series(1, {len(_FEATURES)})) as rank, {len(_FEATURES)} as features, true as importance_falls")
def feature_importance(spark, sf_dir):
    train, _ = _learning_frame(spark, sf_dir)
    model = learning.fit(train.select("key", "label", *_FEATURES), _FEATURES, "label", "random_forest")
    return _ranking(learning.feature_importance(model, _FEATURES, spark))


@register(
    "select_refit",
    "selected:l num_train_rows:l scored_rows:l auc_is_exact:b",
    f"with {_LEARNT} select 5 as selected, n as num_train_rows, vn as scored_rows, true as auc_is_exact from sizes",
)
def select_refit(spark, sf_dir):
    """The five most important features of a first model, and a perceptron fitted to those alone."""
    train, val = (f.select("key", "label", *_FEATURES) for f in _learning_frame(spark, sf_dir))
    chosen = learning.select_by_importance(train, _FEATURES, "label", 5, "random_forest")
    scored = cut_lineage(learning.score(learning.fit(train, chosen, "label", "mlp"), val).select("label", "score"))
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0).evaluate(scored)
    found = metrics.auc_ap(metrics.score_curve(scored)).first().roc_auc
    counts = {"selected": F.lit(len(chosen)), "num_train_rows": F.lit(train.count()), "auc_is_exact": F.lit(abs(found - area) < 1e-9)}
    return scored.agg(F.count("*").alias("scored_rows")).withColumns(counts)


# Learners small enough that SQL can fit them too: every split is searched, every leaf and loss worked out.

_SMALL = ["l_linenumber", "l_discount", "l_tax"]
_SMALL_ROWS = """small as (select l_linenumber as x1, l_discount as x2, l_tax as x3, l_returnflag = 'R' as hit, l_orderkey % 3 <> 0 as tr, count(*) as w from lineitem group by all)"""
_BOOSTED, _STEP = 5, 0.5


def _small_frame(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return [cut_lineage(items.where(part).select("label", *_SMALL)) for part in ("l_orderkey % 3 <> 0", "l_orderkey % 3 = 0")]


def _long_sql(source: str, *columns: str) -> str:
    """(f, x, columns): the training rows of ``source``, once for each feature."""
    return " union all ".join(f"select {f} as f, x{f} as x, {', '.join(columns)} from {source} where tr" for f in (1, 2, 3))


def _boost_sql() -> str:
    """One stump a round, fitted to what the rounds before leave: t0 to t<n> hold the sums of trees, l1 to l<n> the losses."""
    ctes = [_SMALL_ROWS, "t0 as (select *, case when hit then 1 else -1 end as y, 0e0 as total from small)"]
    for m in range(_BOOSTED):
        rest, rate = ("cast(y as double)", "1e0") if m == 0 else ("4e0 * y / (1 + exp(2 * y * total))", f"{_STEP}e0")
        ctes.append(f"r{m} as (select *, {rest} as r from t{m})")
        ctes.append(f"c{m} as (select f, x, sum(w) as n, sum(w * r) as s from ({_long_sql(f'r{m}', 'w', 'r')}) group by 1, 2)")
        ctes.append(f"p{m} as (select f, x, sum(n) over u as n, sum(s) over u as s, sum(n) over (partition by f) as nt, sum(s) over (partition by f) as st, row_number() over (partition by f order by x desc) as back from c{m} window u as (partition by f order by x))")
        ctes.append(f"b{m} as (select f, x as edge, s / n as low, (st - s) / (nt - n) as high from p{m} where back > 1 order by s * s / n + (st - s) * (st - s) / (nt - n) desc, f, x limit 1)")
        ctes.append(f"t{m + 1} as (select x1, x2, x3, hit, tr, w, y, total + {rate} * case when case f when 1 then x1 when 2 then x2 else x3 end <= edge then low else high end as total from r{m} cross join b{m})")
    ctes.append("losses as (" + " union all ".join(f"select {m} as trees, sum(w * 2 * ln(1 + exp(-2 * y * total))) / sum(w) as loss from t{m} where not tr" for m in range(1, _BOOSTED + 1)) + ")")
    ctes.append("best as (select trees from losses order by loss, trees limit 1)")
    return "with " + ", ".join(ctes)


@register("gbt_validated", "trees:l loss:f9 kept:b num_val_rows:l", f"{_boost_sql()} select trees, loss, trees = (select trees from best) as kept, (select sum(w) from small where not tr) as num_val_rows from losses")
def gbt_validated(spark, sf_dir):
    """Boosted stumps: the loss on validation rows after each tree, and the number of trees that the record keeps."""
    train, val = _small_frame(spark, sf_dir)
    found = learning.fit_validated(train, val, _SMALL, "label", maxDepth=1, maxIter=_BOOSTED, stepSize=_STEP, subsamplingRate=1.0)
    record = learning.model_record(train, cut_lineage(learning.score(found.model, val).select("label", "score")), _SMALL, "label", found.trees)
    losses = spark.createDataFrame(list(enumerate(found.losses, 1)), "trees long, loss double")
    return losses.crossJoin(F.broadcast(record.select(F.col("trees").alias("best"), "num_val_rows"))).withColumn("kept", F.col("trees") == F.col("best"))  # one row of record


@register(
    "gbt_scores",
    "l_linenumber:l l_discount:f2 l_tax:f2 rows:l score:f9",
    f"""{_boost_sql()}, every as ({' union all '.join(f"select {m} as trees, x1, x2, x3, w, total from t{m} where not tr" for m in range(1, _BOOSTED + 1))})
    select x1 as l_linenumber, x2 as l_discount, x3 as l_tax, sum(w) as rows, any_value(1 / (1 + exp(-2 * total))) as score from every where trees = (select trees from best) group by 1, 2, 3""",
)
def gbt_scores(spark, sf_dir):
    """What the kept trees give to the validation rows."""
    train, val = _small_frame(spark, sf_dir)
    found = learning.fit_validated(train, val, _SMALL, "label", maxDepth=1, maxIter=_BOOSTED, stepSize=_STEP, subsamplingRate=1.0)
    return learning.score(found.model, val).groupBy(*_SMALL).agg(F.count("*").alias("rows"), F.max("score").alias("score"))


def _gini(n: str, p: str) -> str:
    return f"(1 - pow({p} / {n}, 2) - pow(({n} - {p}) / {n}, 2))"


_TREE_LABEL = "l_linenumber * 2 + l_discount * 100 + case when l_returnflag = 'R' then 3 else 0 end >= 12"


def _tree_sql() -> str:
    """A tree of two levels by Gini: s0 and s1 are the best splits of the nodes, k0 and k1 those that tell classes apart, ``placed`` the rows' last nodes."""
    ctes = [_SMALL_ROWS.replace("l_returnflag = 'R' as hit", f"{_TREE_LABEL} as hit"), "n0 as (select *, 0 as node, 0 as up from small)"]
    for level in (0, 1):
        ctes.append(f"c{level} as (select node, f, x, cast(sum(w) as double) as n, cast(sum(case when hit then w else 0 end) as double) as p from ({_long_sql(f'n{level}', 'node', 'w', 'hit')}) group by 1, 2, 3)")
        ctes.append(f"p{level} as (select node, f, x, sum(n) over u as n, sum(p) over u as p, sum(n) over (partition by node, f) as nt, sum(p) over (partition by node, f) as pt, row_number() over (partition by node, f order by x desc) as back from c{level} window u as (partition by node, f order by x))")
        gain = f"{_gini('nt', 'pt')} - n / nt * {_gini('n', 'p')} - (nt - n) / nt * {_gini('(nt - n)', '(pt - p)')}"
        ctes.append(f"s{level} as (select * from (select node, f, x as edge, nt * ({gain}) as worth, row_number() over (partition by node order by {gain} desc, f, x) as rk from p{level} where back > 1) where rk = 1 and worth > 1e-9)")
        ctes.append(f"n{level + 1} as (select x1, x2, x3, hit, tr, w, case when s.node is null then t.node else 2 * t.node + case when case f when 1 then x1 when 2 then x2 else x3 end <= edge then 1 else 2 end end as node, t.node as up from n{level} t left join s{level} s on s.node = t.node)")
    # Two leaves of one class are one leaf.
    ctes += [f"f{level} as (select node, 2 * sum(case when hit then w else 0 end) > sum(w) as yes from n{level} where tr group by 1)" for level in (1, 2)]
    ctes.append("k1 as (select s.* from s1 s join f2 a on a.node = 2 * s.node + 1 join f2 b on b.node = 2 * s.node + 2 where a.yes <> b.yes)")
    ctes.append("k0 as (select * from s0 where exists (select 1 from k1) or (select count(distinct yes) from f1) > 1)")
    ctes.append("placed as (select x1, x2, x3, hit, tr, w, case when not exists (select 1 from k0) then 0 when up in (select node from k1) then node else up end as node from n2)")
    ctes.append("leaves as (select node, sum(case when hit then w else 0 end) / cast(sum(w) as double) as score from placed where tr group by 1)")
    return "with " + ", ".join(ctes)


def _tree_frame(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("label", F.expr(_TREE_LABEL).cast("int"))
    return [cut_lineage(items.where(part).select("label", *_SMALL)) for part in ("l_orderkey % 3 <> 0", "l_orderkey % 3 = 0")]


def _small_tree(train):
    return learning.fit(train, _SMALL, "label", "random_forest", numTrees=1, maxDepth=2, minInstancesPerNode=1, bootstrap=False, featureSubsetStrategy="all", subsamplingRate=1.0)


@register(
    "tree_importance",
    "rank:l feature:s importance:f9 chosen:b",
    f"""{_tree_sql()}, worth as (select f, sum(worth) as v from (select f, worth from k0 union all select f, worth from k1) group by 1),
    every as (select name as feature, coalesce(v, 0) / (select sum(v) from worth) as importance from (values {', '.join(f"({f}, '{c}')" for f, c in enumerate(_SMALL, 1))}) t(f, name) left join worth using (f))
    select row_number() over (order by importance desc, feature) as rank, feature, importance, row_number() over (order by importance desc, feature) <= 2 as chosen from every""",
)
def tree_importance(spark, sf_dir):
    """Importance and rank of each feature in a tree of two levels, and the two features chosen to refit on."""
    train, _ = _tree_frame(spark, sf_dir)
    options = {"numTrees": 1, "maxDepth": 2, "minInstancesPerNode": 1, "bootstrap": False, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}
    chosen = learning.select_by_importance(train, _SMALL, "label", 2, "random_forest", **options)
    return learning.feature_importance(_small_tree(train), _SMALL, spark).withColumn("chosen", F.col("feature").isin(chosen))


@register(
    "tree_scores",
    "l_linenumber:l l_discount:f2 l_tax:f2 rows:l score:f9",
    f"{_tree_sql()} select x1 as l_linenumber, x2 as l_discount, x3 as l_tax, sum(w) as rows, any_value(score) as score from placed join leaves using (node) where not tr group by 1, 2, 3",
)
def tree_scores(spark, sf_dir):
    """The share of positives in the leaf that each validation row falls into."""
    train, val = _tree_frame(spark, sf_dir)
    return learning.score(_small_tree(train), val).groupBy(*_SMALL).agg(F.count("*").alias("rows"), F.max("score").alias("score"))


@register(
    "model_files",
    "l_linenumber:l l_discount:f2 l_tax:f2 score:f9 threshold:f9 num_train_rows:l num_val_rows:l",
    f"""{_tree_sql()}, v as (select score, sum(w) as n, sum(case when hit then w else 0 end) as p from placed join leaves using (node) where not tr group by 1),
    curve as (select score, cast(sum(p) over (order by score desc) as double) as tp, sum(n) over (order by score desc) as said, (select sum(p) from v) as pos from v),
    marks as (select score, 2 * (tp / said) * (tp / pos) / (tp / said + tp / pos + 1e-9) as f from curve)
    select x1 as l_linenumber, x2 as l_discount, x3 as l_tax, any_value(score) as score, (select score from marks order by f desc, score limit 1) as threshold, (select sum(w) from small where tr) as num_train_rows,
      (select sum(w) from small where not tr) as num_val_rows from placed join leaves using (node) where not tr group by 1, 2, 3""",
)
def model_files(spark, sf_dir):
    """A model with its record and threshold written to files; the scores of the model that was read again."""
    train, val = _tree_frame(spark, sf_dir)
    model, folder = _small_tree(train), f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    record = learning.model_record(train, cut_lineage(learning.score(model, val).select("label", "score")), _SMALL, "label")
    write_model(model, record, folder)
    scored = learning.score(PipelineModel.load(f"{folder}/model"), val).groupBy(*_SMALL).agg(F.max("score").alias("score"))
    stated = spark.read.json(f"{folder}/metadata").select("num_train_rows", "num_val_rows").crossJoin(spark.read.json(f"{folder}/threshold"))  # one row each
    return scored.crossJoin(F.broadcast(stated))


@register("label_encode", "o_orderkey:l label:l", "select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as label from orders")
def label_encode(spark, sf_dir):
    """Class names numbered in alphabetical order."""
    return learning.encode_label(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


_STEPS_SVM = [round(-2.0 + 0.1 * i, 1) for i in range(41)]


@register(
    "imbalanced_pipeline",
    "threshold:f1 sampled_rows:l balanced_rows:l selected:l positives:l n_best:l",
    f"""with {_LEARNT}, s as (select p + least(n - p, 2 * p) as sampled, 2 * greatest(p, least(n - p, 2 * p)) as balanced, vp from sizes)
    select unnest([{', '.join(f'{t}e0' for t in _STEPS_SVM)}]) as threshold, sampled as sampled_rows, balanced as balanced_rows, 4 as selected, vp as positives, 1 as n_best from s""",
)
def imbalanced_pipeline(spark, sf_dir):
    """Down-sample, impute, scale, oversample, select, fit a balanced linear machine, sweep its threshold."""
    train, val = sampling.temporal_split(_unfilled_frame(spark, sf_dir), _CUT)
    found = learning.imbalanced_pipeline(train.drop("date"), val.drop("date"), _FEATURES, "label", "key", ratio=2, k_best=4, thresholds=_STEPS_SVM)
    sweep = found.sweep.withColumns({"positives": F.col("tp") + F.col("fn"), "n_best": F.sum(F.col("is_best").cast("long")).over(Window.partitionBy(F.lit(0)))})
    return sweep.withColumns({"sampled_rows": F.lit(found.sampled_rows), "balanced_rows": F.lit(found.balanced_rows), "selected": F.lit(len(found.selected))})


# Oversampling and its neighbour search, row by row: promotional parts among all others.

_PARTS = "pts as (select p_partkey as k, cast(p_type = 'PROMO' as integer) as label, cast(p_size as double) as x, p_retailprice as y from part)"
_NEAR = """own as (select x, y, count(*) as copies from {source} group by 1, 2),
near as (select a.x, a.y, b.x as nx, b.y as ny, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, least(b.copies - case when a.x = b.x and a.y = b.y then 1 else 0 end, 5) as times from own a cross join own b),
ranked as (select * from (select x, y, nx, ny, d, row_number() over (partition by x, y order by d, nx, ny) as rank from (select *, unnest(generate_series(1, times)) as copy from near where times > 0)) where rank <= 5)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_type") == "PROMO").cast("int").alias("label"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@register("feature_neighbours", "x:f6 y:f6 rank:l nx:f6 ny:f6 d:f6", f"with {_PARTS}, {_NEAR.format(source='pts')} select * from ranked")
def feature_neighbours(spark, sf_dir):
    near = learning.feature_neighbours(_parts(spark, sf_dir).select(F.array("x", "y").alias("vec")), 5)
    rows = near.select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.posexplode("near").alias("at", "n"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("n")[0], 2) + F.pow(F.col("y") - F.col("n")[1], 2))
    return rows.select("x", "y", (F.col("at") + 1).alias("rank"), F.col("n")[0].alias("nx"), F.col("n")[1].alias("ny"), gap.alias("d"))


def _chance_sql(tail: str) -> str:
    return f"(cast(('0x' || substr(md5(k || '|' || no || '|42|{tail}'), 1, 12)) as bigint) / 281474976710656e0)"


@register(
    "smote",
    "label:l synthetic:b x:f6 y:f6",
    f"""with {_PARTS}, small as (select * from pts where label = 1), {_NEAR.format(source='small')},
    quota as (select count(*) filter (where label = 0) - count(*) filter (where label = 1) as need, count(*) filter (where label = 1) as have from pts),
    shared as (select s.*, cast(floor(need / have) as bigint) + case when row_number() over (order by md5(s.k || '|42'), s.k) <= need % have then 1 else 0 end as times from small s cross join quota),
    drawn as (select k, x, y, unnest(generate_series(1, times)) as no from shared where times > 0),
    picked as (select *, 1 + cast(floor({_chance_sql('n')} * 5) as bigint) as rank, {_chance_sql('u')} as u from drawn)
    select label, false as synthetic, x, y from pts union all select 1, true, p.x + u * (r.nx - p.x), p.y + u * (r.ny - p.y) from picked p join ranked r on r.x = p.x and r.y = p.y and r.rank = p.rank""",
)
def smote(spark, sf_dir):
    return learning.smote(_parts(spark, sf_dir), "label", "k", ["x", "y"], 5, 42)
