"""Oversampling in feature space, Spark ML learners, importances and model records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators.distributed import take_by_hash
from terrapanel.operators.spatial import salted
from terrapanel.operators.trees import fit_forest
from terrapanel.session import cut_lineage, fits_broadcast

MEMBER_ROWS = 512  # distinct vectors of a ball
VISITOR_ROWS = 4096  # of those that search it, that meet it in one task
FANOUT = 16  # balls that a ball is split into
TASK_ROWS = 65_536  # rows of a perceptron that one task weighs
SLICE_ROWS = 512  # of those, rows whose layers are held at once


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _distances(here: np.ndarray, there: np.ndarray):
    """(first row, distances) of runs of rows to all others, a few million numbers at a time."""
    step = max(1, 4_000_000 // max(1, there.size))
    for lo in range(0, len(here), step):
        gap = here[lo : lo + step, None, :] - there[None, :, :]
        yield lo, np.sqrt((gap * gap).sum(axis=2))


def _gap(here: str, there: str) -> str:
    """SQL text of the distance of two vectors."""
    return f"sqrt(aggregate(zip_with({here}, {there}, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))"


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join with a table of balls, which is broadcast if its measured size allows."""
    numbers = sum((F.size(n) for n, t in right.dtypes if t == "array<double>"), F.lit(0))
    size = F.coalesce(F.sum(numbers), F.lit(0)) * 8 + F.count("*") * 64
    return left.join(F.broadcast(right) if fits_broadcast(1, right.agg(size.cast("long")).first()[0]) else right, key)


def _box(width: int, low: str = "lo", high: str = "hi") -> list[Column]:
    """The least box, in the directions of the axes, around the vectors of a group."""
    return [F.array(*[f(F.col("vec")[i]) for i in range(width)]).cast("array<double>").alias(n) for f, n in ((F.min, low), (F.max, high))]


def _apart(width: int, low: str, high: str, other_low: str, other_high: str, *, far: bool = False) -> Column:
    """The least distance of two boxes (none where both end at infinity), or the greatest of their places; a vector is a box of its own."""
    gap = "greatest({3}[{4}] - {0}[{4}], {1}[{4}] - {2}[{4}])" if far else "nanvl(greatest({2}[{4}] - {1}[{4}], {0}[{4}] - {3}[{4}], 0D), 0D)"
    return F.expr("sqrt(" + " + ".join(["0D", *[f"pow({gap.format(low, high, other_low, other_high, i)}, 2)" for i in range(width)]]) + ")")


def _split(placed: DataFrame, open_balls: DataFrame, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cut every open ball into up to ``FANOUT`` by pivots drawn from it; (rows with their new ball, the new balls).

    A row goes to its nearest pivot; the pivots of a ball are the least of its rows by
    hash, one for each of ``FANOUT`` shares of them, so both follow from the rows.
    """
    inside = _beside(placed, open_balls.select("ball"), "ball")
    digest = F.xxhash64(F.lit(seed), F.col("ball"), F.col("vec"))
    drawn = inside.groupBy("ball", F.pmod(digest, F.lit(FANOUT)).alias("no")).agg(F.min(F.struct(digest.alias("h"), F.col("vec").alias("vec")))["vec"].alias("vec"))
    pivots = cut_lineage(drawn.groupBy("ball").agg(F.array_sort(F.collect_list(F.struct("no", "vec"))).alias("pivots")))
    pivots = pivots.withColumn("vecs", F.flatten(F.transform("pivots", lambda p: p["vec"])))
    near = F.expr(f"array_min(transform(pivots, p -> named_struct('reach', {_gap('vec', 'p.vec')}, 'no', p.no)))")
    moved = _beside(inside, pivots, "ball").withColumn("near", near)
    rows = cut_lineage(moved.select("vid", "vec", "copies", (F.col("ball") * FANOUT + 1 + F.col("near.no")).alias("ball"), F.col("ball").alias("parent")))
    balls = rows.groupBy("parent", "ball").agg(*_box(width, "plo", "phi"), F.sum("copies").alias("members"), F.count("*").alias("size"))
    return rows.select("vid", "vec", "copies", "ball"), cut_lineage(balls)


def _nearer(reached: DataFrame, k: int) -> DataFrame:
    """Without the balls that can't hold one of the k nearest others of a group's vectors.

    No vector of a group has its k-th nearest other beyond ``reach``, nor beyond the far
    sides of the balls nearest by them, as many as hold k others; balls whose near side
    lies beyond are left out.
    """
    held = F.sum("members").over(Window.partitionBy("home", "scale").orderBy("far", "ball").rowsBetween(Window.unboundedPreceding, 0))
    summed = reached.withColumn("held", held)
    bound = F.min(F.when(F.col("held") > k, F.col("far"))).over(Window.partitionBy("home", "scale"))
    return summed.withColumn("bound", F.least("reach", bound)).where(F.col("near") * (1 - 1e-12) <= F.col("bound")).drop("held", "bound")


def feature_neighbours(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(vec, near): the k nearest other rows of every distinct vector, nearest first, ties by the vector.

    ``points`` holds one ``vec array<double>`` per row; a vector with a missing component
    has no distances and no neighbours.  Equal vectors travel once with their count.
    Balls are split level by level, ``FANOUT`` at a time, until they hold ``MEMBER_ROWS``
    vectors at most.  The k-th nearest in its own ball bounds a vector's search; vectors
    of a ball with bounds of one size go down the levels as one box, and in the end a
    vector visits the balls whose boxes lie within its own bound, so the result is exact.
    Balls are tables and levels are joins, so what reaches the driver doesn't grow.
    A ball meets its visitors piece by piece, however many come.
    """
    known = points.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    distinct = known.groupBy("vec").agg(F.count("*").alias("copies"))
    distinct = cut_lineage(distinct.withColumn("vid", F.monotonically_increasing_id()))
    width = distinct.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    rows = distinct.select("vid", "vec", "copies", F.lit(0).cast("long").alias("ball"))
    balls = rows.groupBy("ball").agg(F.count("*").alias("size"))
    done, levels = [], []
    while True:
        open_balls = cut_lineage(balls.where(F.col("size") > MEMBER_ROWS).select("ball"))
        if open_balls.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(open_balls, "ball", "left_anti"))
        rows, balls = _split(rows, open_balls, width, seed + len(levels))
        levels.append((open_balls, balls))
    placed = done[0].select("vid", "vec", "copies", "ball")
    for more in done[1:]:
        placed = placed.unionByName(more.select("vid", "vec", "copies", "ball"))
    placed = cut_lineage(placed)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        """How far a vector's k-th nearest other may lie at most, by its own ball alone."""
        here, copies = np.stack(group["vec"].to_numpy()), group["copies"].to_numpy()
        bound = np.full(len(here), np.inf)
        if len(here) > k:  # the k + 1 nearest vectors, itself among them, hold k others
            for lo, d in _distances(here, here):
                bound[lo : lo + len(d)] = np.partition(d, k, axis=1)[:, k]
        bound[np.isnan(bound)] = np.inf  # infinite components
        bound[copies > k] = 0.0
        octave = np.where(bound == 0, -2000, np.where(np.isinf(bound), 2000, np.frexp(bound)[1]))
        scale = np.maximum(octave, int(np.median(octave)))  # one group for the nearer half, the rest by octaves
        return pd.DataFrame({"vid": group["vid"], "vec": group["vec"], "home": group["ball"], "bound": bound, "scale": scale})

    asking = cut_lineage(placed.groupBy("ball").applyInPandas(settle, "vid long, vec array<double>, home long, bound double, scale int"))
    # Every group starts at the root; of the balls it has reached, open ones give way to their parts.
    nowhere = F.lit(None).cast("array<double>")
    start = {"ball": F.lit(0).cast("long"), "plo": nowhere, "phi": nowhere, "near": F.lit(0.0), "far": F.lit(float("inf")), "members": F.lit(0).cast("long")}
    groups = asking.groupBy("home", "scale").agg(*_box(width), F.max("bound").alias("reach"))
    own = ["home", "scale", "lo", "hi", "reach"]
    reached = groups.select(*own, *[c.alias(n) for n, c in start.items()])
    for open_balls, parts in levels:
        closed = reached.join(open_balls, "ball", "left_anti")
        below = _beside(reached.join(open_balls, "ball").select(*own, F.col("ball").alias("parent")), parts.drop("size"), "parent")
        boxes = (width, "lo", "hi", "plo", "phi")
        below = below.select(*own, "ball", "plo", "phi", _apart(*boxes).alias("near"), _apart(*boxes, far=True).alias("far"), "members")
        reached = cut_lineage(_nearer(closed.select(*below.columns).unionByName(below), k))
    within = F.col("plo").isNull() | (_apart(width, "vec", "vec", "plo", "phi") * (1 - 1e-12) <= F.col("bound"))
    visits = asking.join(reached.select("home", "scale", F.col("ball").alias("p"), "plo", "phi"), ["home", "scale"]).where(within)
    visits = cut_lineage(visits.select("vid", "vec", "bound", "p"))
    # The visitors of a ball are cut into pieces of bounded size; the ball meets every piece.
    pieces = cut_lineage(visits.groupBy("p").agg(F.ceil(F.count("*") / VISITOR_ROWS).cast("int").alias("v")))
    pieces = F.broadcast(pieces) if fits_broadcast(pieces.count(), 32) else pieces  # one row per ball
    left = visits.join(pieces, "p").withColumn("i", F.pmod(F.xxhash64("vid"), F.col("v")).cast("int"))
    # Both sides come from one table; under names of its own the right one is told apart.
    right = placed.select(F.col("ball").alias("p"), *[F.col(c).alias(c) for c in ("vid", "vec", "copies")]).join(pieces, "p")
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))

    def search(rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        found = {"vid": [], "d": [], "near": []}
        if len(rows) and len(group):
            here, there = np.stack(rows["vec"].to_numpy()), np.stack(group["vec"].to_numpy())
            asking, ids, copies, bound = rows["vid"].to_numpy(), group["vid"].to_numpy(), group["copies"].to_numpy(), rows["bound"].to_numpy()
            most = min(k + 1, len(there)) - 1
            for lo, d in _distances(here, there):
                hit = d <= bound[lo : lo + len(d), None]
                # The k + 1 nearest vectors hold k others; all that tie with the last of them come along.
                many = np.flatnonzero(hit.sum(axis=1) > most + 1)
                hit[many] = d[many] <= np.partition(d[many], most, axis=1)[:, most, None]
                row, at = np.nonzero(hit)
                times = np.minimum(copies[at] - (asking[lo + row] == ids[at]), k)
                row, at = np.repeat(row, times), np.repeat(at, times)
                found["vid"].append(asking[lo + row])
                found["d"].append(d[row, at])
                found["near"] += list(there[at])
            found["vid"], found["d"] = np.concatenate(found["vid"]), np.concatenate(found["d"])
        return pd.DataFrame({**found, "near": pd.Series(found["near"], dtype=object)})  # also where nothing is found

    partial = left.select("p", "i", "vid", "vec", "bound").groupBy("p", "i").cogroup(right.select("p", "i", "vid", "vec", "copies").groupBy("p", "i"))
    hits = partial.applyInPandas(search, "vid long, d double, near array<double>")
    best = F.row_number().over(Window.partitionBy("vid").orderBy("d", "near"))
    ranked = hits.withColumn("rank", best).where(F.col("rank") <= k).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "near"))).alias("hits"))
    return distinct.select("vid", "vec").join(ranked, "vid").select("vec", F.transform("hits", lambda h: h["near"]).alias("near"))


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """(label, *features, synthetic): the rows plus new minority rows up to equal class sizes.

    Each new row lies between a minority row and one of its k nearest minority rows.
    New rows are shared evenly among minority rows; the choice of neighbour and place
    follows from md5(key | number | seed).
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    minority = min(sizes, key=sizes.get)
    have, need = sizes[minority], max(sizes.values()) - sizes[minority]
    original = df.select(label, *[F.col(c).cast("double").alias(c) for c in features], F.lit(False).alias("synthetic"))
    if have < 2 or need == 0:
        return original
    vector = F.array(*[F.col(c).cast("double") for c in features])
    small = df.where(F.col(label) == minority).select(F.col(key).alias("_key"), F.col(label), vector.alias("vec"))
    near = feature_neighbours(small.select("vec"), min(k, have - 1), seed)
    remainder = F.lit(need % have).cast("long").alias("_quota")
    shared = take_by_hash(small, "_key", label, lambda sizes: sizes.select(label, remainder), seed).withColumn("_times", F.lit(need // have) + F.col("_taken").cast("int"))
    left, right = salted(shared.where("_times > 0"), near, F.col("_key"))
    sources = left.join(right, ["vec", "_salt"]).drop("_salt")
    drawn = sources.withColumn("_no", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    which = F.floor(_uniform(F.col("_key"), F.col("_no"), F.lit(seed), F.lit("n")) * F.size("near")).cast("int")
    drawn = drawn.withColumns({"_other": F.col("near")[which], "_u": _uniform(F.col("_key"), F.col("_no"), F.lit(seed), F.lit("u"))})
    place = F.zip_with("vec", "_other", lambda a, b: a + F.col("_u") * (b - a))
    made = drawn.select(label, place.alias("x"))
    return original.unionByName(made.select(label, *[F.col("x")[i].alias(c) for i, c in enumerate(features)], F.lit(True).alias("synthetic")))


def encode_label(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """Numeric labels as they are; other values numbered in alphabetical order."""
    if dict(df.dtypes)[label] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return df.withColumn(out, F.col(label).cast("double"))
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)


def learner(name: str, features: int, label: str, weight: str | None = None, **options):
    """A Spark ML classifier: ``gbt``, ``random_forest``, ``svm`` or ``mlp``.

    ``trees.fit_forest`` fits forests of two classes.  Where Spark fits one, it keeps which
    node every row has reached in every tree; else each level would walk each row down
    each tree again from its root.
    """
    common = {"featuresCol": "features", "labelCol": label}
    weighted = {**common, **({"weightCol": weight} if weight else {})}
    if name == "gbt":
        return GBTClassifier(**{**weighted, "maxDepth": 6, "maxIter": 500, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42, **options})
    if name == "random_forest":
        return RandomForestClassifier(**{**weighted, "numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 4, "cacheNodeIds": True, "seed": 42, **options})
    if name == "svm":
        return LinearSVC(**{**weighted, "regParam": 0.01, "maxIter": 100, **options})
    if name == "mlp":
        return MultilayerPerceptronClassifier(**{**common, "layers": [features, 128, 64, 2], "maxIter": 100, "seed": 42, **options})
    raise ValueError(f"unknown learner {name!r}")


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, intercepts) of every layer, as views of the weights in Spark's order."""
    found, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        found.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + (n + 1) * m]))
        at += (n + 1) * m
    return found


def _cross_entropy(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: Sequence[int]) -> tuple[float, np.ndarray]:
    """(sum over the rows, its gradient) for logistic hidden layers under a softmax."""
    layers, gradient = _layers(weights, sizes), np.empty_like(weights)
    values = [x]
    for matrix, intercepts in layers[:-1]:
        z = values[-1] @ matrix
        z += intercepts
        with np.errstate(over="ignore"):
            np.exp(np.negative(z, out=z), out=z)
        z += 1.0
        values.append(np.reciprocal(z, out=z))
    z = values[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    delta, row = np.exp(z), np.arange(len(y))
    total = delta.sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0]) - z[row, y]).sum())
    delta /= total
    delta[row, y] -= 1.0
    for i, (matrix, intercepts) in reversed(list(enumerate(_layers(gradient, sizes)))):
        np.matmul(values[i].T, delta, out=matrix)
        delta.sum(axis=0, out=intercepts)
        if i:
            delta = delta @ layers[i][0].T
            delta *= values[i]
            delta *= 1.0 - values[i]
    return loss, gradient


@dataclass
class _Point:
    """A place on the line that a descent searches."""

    t: float
    x: np.ndarray
    value: float
    gradient: np.ndarray
    slope: float  # along the line


def _between(left: _Point, right: _Point) -> float:
    """Where the cubic through two points is least, not too near to either."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d1 = left.slope + right.slope - 3 * np.float64(left.value - right.value) / (left.t - right.t)
        d2 = np.sqrt(d1 * d1 - left.slope * right.slope)
        t = right.t - (right.t - left.t) * (right.slope + d2 - d1) / (right.slope - left.slope + 2 * d2)
    return float(np.clip(t, left.t + 0.1 * (right.t - left.t), left.t + 0.9 * (right.t - left.t)))


def _line_search(at, start: _Point, t: float, tries: int = 10) -> _Point | None:
    """A point of the line that meets the strong Wolfe conditions; ``at`` weighs one."""

    def worse(c: _Point) -> bool:
        return c.value > start.value + 1e-4 * c.t * start.slope

    def flat(c: _Point) -> bool:
        return abs(c.slope) <= 0.9 * abs(start.slope)

    def zoom(low: _Point, high: _Point) -> _Point | None:
        for _ in range(tries):
            where = _between(*sorted((low, high), key=lambda p: p.t))
            if np.isnan(where):
                return None
            c = at(where)
            if worse(c) or c.value >= low.value:
                high = c
                continue
            if flat(c):
                return c
            high, low = low if c.slope * (high.t - low.t) >= 0 else high, c
        return None

    low = start
    for i in range(tries if start.slope <= 0 else 0):
        c = at(t)
        if not np.isfinite(c.value):
            t /= 2
            continue
        if worse(c) or (i > 0 and c.value >= low.value):
            return zoom(low, c)
        if flat(c):
            return c
        if c.slope >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def _descend(weigh, x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with the line search and the stops of Spark's own; ``weigh`` gives value and gradient.

    A failed search is tried once more along the gradient.  The value counts as settled
    when it is within the tolerance of the greatest of the last twenty.
    """
    value, gradient = weigh(x)
    first, recent, history, step, failed = value, [np.inf], [], 0, False
    while step < steps:
        settled = len(recent) > 1 and abs(value - max(recent)) <= tolerance * first
        if settled or np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            break
        way, shares = gradient.copy(), []
        for s, g in history:  # the latest first
            shares.append(s @ way / (s @ g))
            way -= shares[-1] * g
        if history:
            way *= history[0][0] @ history[0][1] / (history[0][1] @ history[0][1])
        for (s, g), share in reversed(list(zip(history, shares))):
            way += (share - g @ way / (s @ g)) * s
        way = -way

        def at(t: float) -> _Point:
            there = x + t * way
            v, g = weigh(there)
            return _Point(t, there, v, g, float(g @ way))

        start = _Point(0.0, x, value, gradient, float(gradient @ way))
        found = _line_search(at, start, 1.0 if step else 1.0 / float(np.linalg.norm(way)))
        if found is None or found.t * np.linalg.norm(gradient) < 1e-10:
            if failed:
                break
            history, failed = [], True
            continue
        history = [(found.x - x, found.gradient - gradient), *history][:memory]
        x, value, gradient, step, failed = found.x, found.value, found.gradient, step + 1, False
        recent = [*recent, value][-20:]
    return x


def fit_perceptron(df: DataFrame, classifier: MultilayerPerceptronClassifier):
    """Spark's perceptron, with the gradient of all rows worked out by NumPy in the tasks.

    First weights, descent and model are those of the classifier.  Every row weighs the
    same, however rows lie in tasks; Spark takes the mean over the means of blocks,
    in which the rows of a task's last, shorter block weigh more.
    """
    spark, label = df.sparkSession, classifier.getLabelCol()
    sizes = classifier.getLayers()
    blank = spark.createDataFrame([(Vectors.dense([0.0] * sizes[0]),)], ["features"]).withColumn(label, F.lit(0).cast(df.schema[label].dataType))

    def unmoved(params: dict):
        return classifier.copy({classifier.maxIter: 0, **params}).fit(blank)

    start = unmoved({}).weights.toArray()
    n_rows = df.count()
    if not n_rows:
        raise ValueError("no rows to train on")
    classes, vector = F.col(label).cast("double"), vector_to_array("features")
    known = F.coalesce((classes >= 0) & (classes < sizes[-1]) & (classes == F.floor(classes)), F.lit(False))
    odd_class = F.raise_error(F.concat(F.lit("no class of the perceptron: "), F.coalesce(classes.cast("string"), F.lit("null"))))
    odd_value = F.raise_error(F.lit("features of a perceptron must be finite"))
    rows = df.select(
        F.when(F.forall(vector, lambda v: F.abs(v) < float("inf")), vector).otherwise(odd_value.cast("array<double>")).alias("x"),
        F.when(known, classes.cast("int")).otherwise(odd_class.cast("int")).alias("y"),
    )

    def packed(batches):
        """Rows as bytes, many at a time, so that weighing them takes no conversion."""
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, sizes[0])
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cuts = range(0, len(y), SLICE_ROWS)
            yield pa.RecordBatch.from_pydict({n: pa.array([v[i : i + SLICE_ROWS].tobytes() for i in cuts], pa.binary()) for n, v in (("x", x), ("y", y))})

    spread = rows.repartition(-(-n_rows // TASK_ROWS))
    blocks = spread.mapInArrow(packed, "x binary, y binary").rdd.map(lambda r: (bytes(r["x"]), bytes(r["y"]))).persist(StorageLevel.MEMORY_AND_DISK)

    def weigh(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def add(total: np.ndarray, block: tuple[bytes, bytes]) -> np.ndarray:
            x, y = np.frombuffer(block[0]).reshape(-1, sizes[0]), np.frombuffer(block[1], np.int32)
            loss, gradient = _cross_entropy(x, y, weights, sizes)
            return total + np.concatenate([[loss, len(y)], gradient])

        total = blocks.treeAggregate(np.zeros(len(weights) + 2), add, np.add)
        return float(total[0] / total[1]), total[2:] / total[1]

    try:
        weights = _descend(weigh, start, classifier.getMaxIter(), classifier.getTol())
    finally:
        blocks.unpersist()
    model = unmoved({classifier.initialWeights: Vectors.dense(weights)})
    model.set(model.maxIter, classifier.getMaxIter())
    if not classifier.isSet(classifier.initialWeights):
        model.clear(model.initialWeights)
    return model


def fit(df: DataFrame, features: Sequence[str], label: str, name: str, weight: str | None = None, **options) -> PipelineModel:
    """Assemble (rows with missing features are an error, impute first) and train."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    chosen = learner(name, len(features), label, weight, **options)
    if name == "mlp" and chosen.getSolver() == "l-bfgs":
        return PipelineModel(stages=[assembler, fit_perceptron(assembler.transform(df), chosen)])
    if name == "random_forest":
        return PipelineModel(stages=[assembler, fit_forest(assembler.transform(df), chosen, features)])
    return Pipeline(stages=[assembler, chosen]).fit(df)


@dataclass
class ValidatedModel:
    """Boosted trees up to the one at which the loss on validation rows is least."""

    model: PipelineModel
    trees: int
    losses: list[float]  # on the validation rows, after each tree that was tried


def fit_validated(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, weight: str | None = None, **options) -> ValidatedModel:
    """Boost all trees, weigh every number of first trees on ``val``, keep the best (the fewest of equals).

    The kept trees are fitted again alone: with the same seed they are the same ones.
    One number per tree reaches the driver.
    """
    whole = fit(train, features, label, "gbt", weight, **options)
    losses = [float(v) for v in whole.stages[-1].evaluateEachIteration(whole.stages[0].transform(val))]
    trees = losses.index(min(losses)) + 1
    kept = whole if trees == len(losses) else fit(train, features, label, "gbt", weight, **{**options, "maxIter": trees})
    return ValidatedModel(kept, trees, losses)


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of class 1, or the decision value of a margin classifier."""
    scored = model.transform(df)
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(out, vector_to_array(column)[1]).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(rank, feature, importance): tree importances, or absolute coefficients of a linear model (with their sign kept)."""
    fitted = model.stages[-1]
    linear = hasattr(fitted, "coefficients")
    values = [float(v) for v in (fitted.coefficients if linear else fitted.featureImportances).toArray()]
    ordered = sorted(zip(features, values), key=lambda t: (-abs(t[1]), t[0]))
    rows = [(i + 1, f, abs(v), v if linear else None) for i, (f, v) in enumerate(ordered)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, coefficient double")


def select_by_importance(df: DataFrame, features: Sequence[str], label: str, k: int = 20, name: str = "random_forest", **options) -> list[str]:
    """The k features a first model ranks highest, to refit on."""
    model = fit(df, features, label, name, **options)
    return [r.feature for r in feature_importance(model, features, df.sparkSession).where(F.col("rank") <= k).orderBy("rank").collect()]


@dataclass
class ImbalancedModel:
    """A linear machine fitted to few positives, and what led to it."""

    model: PipelineModel
    selected: list[str]
    sampled_rows: int
    balanced_rows: int
    sweep: DataFrame  # one row per threshold, the best marked
    importance: DataFrame  # rank, feature, importance, coefficient


def imbalanced_pipeline(
    train: DataFrame, val: DataFrame, features: Sequence[str], label: str, key: str, *, ratio: int = 20, k: int = 5, k_best: int = 25, thresholds: Sequence[float], seed: int = 42, **options
) -> ImbalancedModel:
    """Down-sample the negatives, impute and scale by what is left, oversample the positives, keep the
    ``k_best`` features by mutual information, fit a linear machine with balanced weights, and sweep
    its threshold on the validation rows."""
    from terrapanel.operators import metrics, sampling

    sampled = cut_lineage(sampling.downsample(train, label, key, ratio, seed))
    filled = [f.na.fill(0.0, list(features)) for f in sampling.impute_median(sampled, features, val)]
    scaled, scaled_val = sampling.standardise(filled[0], features, filled[1])
    whole = cut_lineage(smote(scaled, label, key, features, k, seed))
    scores = sampling.select_k_best(sampling.mutual_information(whole, features, label), min(k_best, len(features)))
    selected = [r.feature for r in scores.orderBy(F.col("mi").desc(), "feature").collect()]  # one row per feature
    model = fit(sampling.with_class_weight(whole, label, balanced=True), selected, label, "svm", "weight", **options)
    sweep = metrics.threshold_sweep(cut_lineage(score(model, scaled_val).select(label, "score")), thresholds, "score", label)
    return ImbalancedModel(model, selected, sampled.count(), whole.count(), sweep, feature_importance(model, selected, train.sparkSession))


METADATA_SCHEMA = T.StructType(
    [
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("auc_pr", T.DoubleType()),
        T.StructField("best_threshold", T.DoubleType()),
        T.StructField("num_train_rows", T.LongType()),
        T.StructField("num_val_rows", T.LongType()),
        T.StructField("train_fire_cases", T.LongType()),
        T.StructField("val_fire_cases", T.LongType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("scale_pos_weight", T.DoubleType()),
        T.StructField("trees", T.LongType()),
    ]
)


def model_record(train: DataFrame, val_scored: DataFrame, features: Sequence[str], label: str, trees: int | None = None) -> DataFrame:
    """One row describing a trained model on its validation scores; ``trees`` are those kept by validation."""
    from terrapanel.operators.metrics import auc_ap, best_threshold, score_curve
    from terrapanel.operators.sampling import class_balance

    curve = score_curve(val_scored, "score", label)
    quality, best, balance = auc_ap(curve).first(), best_threshold(curve).first(), class_balance(train, label).first()
    val = val_scored.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    row = (
        quality.roc_auc, quality.avg_precision, best.threshold, balance.n_pos + balance.n_neg, val.n,
        balance.n_pos, val.p, list(features), float(balance.scale_pos_weight), trees,
    )
    return train.sparkSession.createDataFrame([row], METADATA_SCHEMA)
