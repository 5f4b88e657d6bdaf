"""Splits, sampling, imputation, scaling and minority oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.operators.distributed import exact_quantiles, hash_text, prefix_sums, take_by_hash, with_range_bucket
from terrapanel.session import cut_lineage


def temporal_split(df: DataFrame, cut: str, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows before ``cut``, rows from ``cut`` on)."""
    day = F.lit(cut).cast("date")
    return df.where(F.col(date) < day), df.where(F.col(date) >= day)


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42, *, exact: bool = True) -> DataFrame:
    """Adds ``is_test``: ``share`` of every class, chosen by md5(key|seed).

    ``exact`` takes round(share * class size) rows per class; otherwise a hash
    threshold decides row by row, without any shuffle.
    """
    if not exact:
        hashed = F.conv(F.substring(hash_text(F.col(key), seed), 1, 8), 16, 10).cast("double")
        return df.withColumn("is_test", hashed / 4294967296.0 < share)
    part = F.floor(F.col("_n") * F.lit(float(share)) + 0.5).cast("long").alias("_quota")
    return take_by_hash(df, key, label, lambda sizes: sizes.select(label, part), seed).withColumnRenamed("_taken", "is_test")


def downsample(df: DataFrame, label: str, key: str, ratio: int = 20, seed: int = 42) -> DataFrame:
    """All positives and ``ratio`` times as many negatives (all of them if fewer)."""

    def quota(sizes: DataFrame) -> DataFrame:
        positives = sizes.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("_n"))), F.lit(0))).scalar()
        return sizes.select(label, F.when(F.col(label) == 1, F.col("_n")).otherwise(F.least(F.col("_n"), positives * ratio)).alias("_quota"))

    return take_by_hash(df, key, label, quota, seed).where("_taken").drop("_taken")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: class counts, neg/pos ratio and balanced weights n / (2 * n_class)."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return counts.select(
        "n_pos",
        "n_neg",
        (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("scale_pos_weight"),
        F.try_divide(F.col("n").cast("double"), 2.0 * F.col("n_neg")).alias("weight_neg"),
        F.try_divide(F.col("n").cast("double"), 2.0 * F.col("n_pos")).alias("weight_pos"),
    )


def with_class_weight(df: DataFrame, label: str = "label", *, balanced: bool = False, out: str = "weight") -> DataFrame:
    balance = class_balance(df, label).first()
    neg, pos = (balance.weight_neg, balance.weight_pos) if balanced else (1.0, float(balance.scale_pos_weight))
    return df.withColumn(out, F.when(F.col(label) == 1, pos).otherwise(neg))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column; NULL for a column without values."""
    found = exact_quantiles(df, columns, [0.5])
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def impute_median(train: DataFrame, columns: Sequence[str], *others: DataFrame) -> list[DataFrame]:
    """Fill NULLs of all frames with the medians of ``train``."""
    fitted = medians(train, columns).first()  # one row of statistics
    return [d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fitted[c])) for c in columns}) for d in (train, *others)]


def standardise(train: DataFrame, columns: Sequence[str], *others: DataFrame) -> list[DataFrame]:
    """(x - mean) / population standard deviation of ``train``; constant columns are only centred."""
    fitted = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()

    def scaled(c: str) -> Column:
        return (F.col(c) - F.lit(fitted[f"m_{c}"])) / F.lit(fitted[f"s_{c}"] or 1.0)

    return [d.withColumns({c: scaled(c) for c in columns}) for d in (train, *others)]


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information in nats between equal-width bins of a feature and the label."""
    span = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()

    def slot(c: str) -> Column:
        low, high = span[f"lo_{c}"], span[f"hi_{c}"]
        if low is None or high <= low:
            return F.when(F.col(c).isNotNull(), 0)
        return F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")

    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), slot(c).alias("slot")) for c in columns])
    joint = df.select(F.col(label).alias("_y"), F.explode(pairs).alias("p")).groupBy("p.feature", "p.slot", "_y").agg(F.count("*").alias("n"))

    def total(*by: str) -> Column:  # at most bins x classes rows per feature
        return F.sum("n").over(Window.partitionBy(*by))

    share = F.col("n") / total("feature")
    mass = share * F.ln(F.col("n") * total("feature") / (total("feature", "slot") * total("feature", "_y")))
    return joint.select("feature", mass.alias("m")).groupBy("feature").agg(F.sum("m").alias("mi"))


def digamma(n: str) -> str:
    """SQL text of the digamma function of a positive number: ten steps up, then its asymptotic series."""
    x = f"(cast({n} as double) + 10D)"
    steps = " + ".join(f"1D / (cast({n} as double) + {k}D)" for k in range(10))
    square = f"({x} * {x})"
    series = f"1D / {square} * (1D / 12 - 1D / {square} * (1D / 120 - 1D / {square} * (1D / 252 - 1D / {square} * (1D / 240 - 1D / {square} / 132))))"
    return f"(ln({x}) - 0.5D / {x} - {series} - ({steps}))"


def _kth_gaps(counted: DataFrame, k: int) -> DataFrame:
    """Adds ``_k`` and ``_d`` to (feature, _y, value, n, size): the distance to the k-th nearest row of the same class.

    Values are cut into ranges per feature and class.  A range takes along the k values
    before and behind it, read from a table of every range's first and last k, so that
    each is settled by itself in one pass.
    """
    keyed = counted.withColumn("_class", F.concat_ws("|", "feature", F.col("_y").cast("string")))
    ranged = cut_lineage(with_range_bucket(keyed, ["_class"], "value"))
    inside = Window.partitionBy("_class", "_bucket")
    first, last = F.row_number().over(inside.orderBy("value")), F.row_number().over(inside.orderBy(F.col("value").desc()))
    rim = cut_lineage(ranged.select("_class", "_bucket", "value", "n", first.alias("_i"), last.alias("_j")).where((F.col("_i") <= k) | (F.col("_j") <= k)))
    # One row per range and at most 2k values: what lies before its first and behind its last value.
    line = Window.partitionBy("_class").orderBy("value")
    spot = F.struct("value", "n")
    before = F.filter(F.array(*[F.lag(spot, s).over(line) for s in range(1, k + 1)]), lambda v: v.isNotNull())
    behind = F.filter(F.array(*[F.lead(spot, s).over(line) for s in range(1, k + 1)]), lambda v: v.isNotNull())
    around = rim.select("_class", "_bucket", "_i", "_j", before.alias("_before"), behind.alias("_behind"))
    halo = around.groupBy("_class", "_bucket").agg(F.max(F.when(F.col("_i") == 1, F.col("_before"))).alias("_before"), F.max(F.when(F.col("_j") == 1, F.col("_behind"))).alias("_behind"))
    both = F.explode(F.concat(F.coalesce("_before", F.array().cast("array<struct<value:double,n:bigint>>")), F.coalesce("_behind", F.array().cast("array<struct<value:double,n:bigint>>"))))
    guests = halo.select("_class", "_bucket", both.alias("v")).select("_class", "_bucket", "v.value", "v.n", F.lit(True).alias("_guest"))
    whole = ranged.withColumn("_guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    near = inside.orderBy("value")
    nearest = F.filter(F.array(*[F.lag(spot, s).over(near) for s in range(1, k + 1)], *[F.lead(spot, s).over(near) for s in range(1, k + 1)]), lambda v: v.isNotNull())
    listed = whole.withColumn("_near", nearest).where("not _guest").withColumn("_k", F.least(F.lit(k).cast("long"), F.col("size") - 1))
    gaps = F.flatten(F.transform("_near", lambda v: F.array_repeat(F.abs(v["value"] - F.col("value")), F.least(v["n"], F.lit(k)).cast("int"))))
    own = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    kth = F.try_element_at(F.array_sort(F.concat(own, gaps)), F.col("_k").cast("int"))
    return listed.withColumn("_d", kth).select("feature", "_y", "value", "n", "size", "_k", "_d")


def mutual_information_neighbours(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mi): mutual information in nats of each feature and the classes of ``label``, from nearest neighbours.

    For every row: the distance to its k-th nearest row of the same class, and how many
    rows of any class lie nearer than that (Ross 2014).  Rows of classes of one row, and
    NULLs, are left out; ties count as they are.  Unlike bins, distances between
    neighbours don't change with a value far away.

    Equal values are one row with their counts; neighbours and counts come from ranges
    of sorted values, so no task holds a feature or a class.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    listed = df.select(F.col(label).cast("string").alias("_y"), F.inline(pairs)).where("value is not null and _y is not null")
    counted = listed.groupBy("feature", "_y", F.expr("value + 0D").alias("value")).agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    sizes = counted.groupBy("feature", "_y").agg(F.sum("n").alias("size")).where("size > 1")  # one row per feature and class
    counted = cut_lineage(counted.join(F.broadcast(sizes), ["feature", "_y"]))
    found = _kth_gaps(counted, k)
    found = cut_lineage(found.withColumns({"_lo": F.col("value") - F.col("_d"), "_hi": F.col("value") + F.col("_d")}))
    # Running counts at all values and at both ends of every row's neighbourhood.
    ends = found.where("_d > 0").select("feature", F.explode(F.array("_lo", "_hi")).alias("at"), F.lit(0).cast("long").alias("n"))
    places = counted.select("feature", F.col("value").alias("at"), "n").unionByName(ends).groupBy("feature", "at").agg(F.sum("n").alias("n"))
    upto = cut_lineage(prefix_sums(cut_lineage(places), "at", {"upto": "n"}, group=["feature"]))
    low = upto.select("feature", F.col("at").alias("_lo"), F.col("upto").alias("_low"))
    high = upto.select("feature", F.col("at").alias("_hi"), (F.col("upto") - F.col("n")).alias("_high"))
    here = upto.select("feature", F.col("at").alias("value"), F.col("n").alias("_here"))
    nearer = found.where("_d > 0").join(low, ["feature", "_lo"]).join(high, ["feature", "_hi"]).select("feature", "n", "size", "_k", (F.col("_high") - F.col("_low")).alias("_m"))
    same = found.where("_d = 0").join(here, ["feature", "value"]).select("feature", "n", "size", "_k", F.col("_here").alias("_m"))
    terms = nearer.unionByName(same).select("feature", "n", F.expr(f"{digamma('_k')} - {digamma('size')} - {digamma('_m')}").alias("term"))
    means = terms.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("term")) / F.sum("n")).alias("mean"))
    known = means.select("feature", F.greatest(F.expr(f"{digamma('n')} + mean"), F.lit(0.0)).alias("mi"))
    none = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return none.join(F.broadcast(known), "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def select_k_best(scores: DataFrame, k: int, score: str = "mi", name: str = "feature") -> DataFrame:
    return scores.orderBy(F.col(score).desc(), name).limit(k)
