"""Column selection by models and statistics, training, search, scoring and the model registry."""

from __future__ import annotations

import contextlib
import math
import random
import statistics
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import Any

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.operators import boosting
from tidemark.operators.boosting import BoostedModel
from tidemark.operators.evaluation import evaluate
from tidemark.operators.sampling import class_weights, walk_forward_folds, with_class_weight
from tidemark.plans.parts import join_stats
from tidemark.plans.quantiles import exact_quantiles, unpivot
from tidemark.plans.series import BARS, Axis, Halo, running, total
from tidemark.session import stage

SEED = 42


def complete(cols: Sequence[str]) -> Column:
    """Whether a row has a value in each column; models learn from such rows and score no others."""
    known = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        known = known & x.isNotNull() & ~F.isnan(x)
    return known


def assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The complete rows with their columns as one vector, to learn from."""
    return VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df.filter(complete(cols)))


def _forest(label: str, trees: int = 100, depth: int = 5, **params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, **params)


def importances(df: DataFrame, cols: Sequence[str], label: str, trees: int = 100, **params) -> list[tuple[str, float]]:
    """Forest importances, largest first."""
    model = _forest(label, trees, **params).fit(assembled(df, cols))
    pairs = zip(cols, (float(v) for v in model.featureImportances.toArray()))
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def select_importance(df: DataFrame, cols: Sequence[str], label: str, n: int, trees: int = 100) -> list[str]:
    return [c for c, _ in importances(df, cols, label, trees)[:n]]


def anova_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, f_value): variance between classes over variance within, from one aggregate per class."""
    per_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.var_pop(c).alias(f"v_{c}") for c in cols],
    )
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in cols]
    # Classes times features rows.
    long = per_class.select("n", F.inline(F.array(*entries)))
    over = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over)
    sums = long.withColumn("_grand", grand).groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("_grand")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("rows"),
    )
    f_value = (F.col("between") / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("rows") - F.col("k")), F.lit(0.0))
    return sums.select("feature", f_value.alias("f_value"))


def _top(scores: DataFrame, column: str, n: int) -> list[str]:
    """The best ``n`` of a table with one row per feature."""
    return [r["feature"] for r in scores.orderBy(F.col(column).desc_nulls_last(), "feature").limit(n).collect()]


def select_anova(df: DataFrame, cols: Sequence[str], label: str, n: int) -> list[str]:
    return _top(anova_scores(df, cols, label), "f_value", n)


def mutual_info_scores(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_info) in nats between the class and the feature cut at its quantiles.

    The pass over the rows is one count per (feature, bin, class).
    """
    cuts = exact_quantiles(df.select(F.lit(0).alias("_all"), *cols), cols, [i / bins for i in range(1, bins)], ["_all"])
    cuts = cuts.select("column", F.col("q").alias("_cuts"))
    long = unpivot(df.select(F.col(label).alias("_y"), *cols), ["_y"], cols).join(F.broadcast(cuts), "column")
    part = F.size(F.filter("_cuts", lambda q: q < F.col("x")))
    counts = long.groupBy(F.col("column").alias("feature"), part.alias("bin"), "_y").agg(F.count(F.lit(1)).alias("n"))
    f, b, y = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "_y")
    whole = F.sum("n").over(f)
    share = F.col("n") / whole
    ratio = F.col("n") * whole / (F.sum("n").over(b) * F.sum("n").over(y))
    terms = counts.withColumn("_term", share * F.log(ratio))
    return terms.groupBy("feature").agg(F.sum("_term").alias("mutual_info"))


def digamma(n: Column) -> Column:
    """The logarithmic derivative of the gamma function at n >= 1, to about 1e-10."""
    y = n + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return reduce(lambda a, i: a - 1 / (n + i), range(6), series)


def mutual_info_neighbours(df: DataFrame, cols: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mutual_info) in nats between the class and a column, from distances to neighbours, at least 0.

    A row's radius is the distance to its ``k``-th nearest row of its class (the furthest one in a smaller class); the more
    rows of any class lie within it (nearer than the radius, or at the same value), the less the value tells. Classes of
    one row, nulls and NaN are left out. Values are sorted by class for the radii, and together with the ends of all
    intervals for the counts; both sorts are cut into parts of like size, and no pair of rows is formed.
    """
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = unpivot(rows, ["_y"], cols).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    long = stage(long.select("column", "_y", "x").withColumn("_id", F.monotonically_increasing_id()), "values")
    h = Halo.spread(long, Axis(keys=("column", "_y"), ts="x", ties=("_id",), cell=None), back=k, ahead=k)
    x = F.col("x")
    below = [F.lit(0.0), *[x - F.lag(x, a).over(h.w) for a in range(1, k + 1)]]
    above = [F.lit(0.0), *[F.lead(x, a).over(h.w) - x for a in range(1, k + 1)]]
    sides = {f"_{side}{a}": d for side, ds in (("below", below), ("above", above)) for a, d in enumerate(ds)}
    frame = h.frame.withColumns(sides)

    def radius(n: int) -> Column:
        """Of the runs of n + 1 values with this one among them the one that reaches least far from it."""
        both = lambda a: F.when(F.col(f"_below{a}").isNotNull() & F.col(f"_above{n - a}").isNotNull(), F.greatest(f"_below{a}", f"_above{n - a}"))
        found = [both(a) for a in range(n + 1)]
        return F.least(*found)

    radii = [radius(n) for n in range(k, 0, -1)]
    reached = F.coalesce(*[F.when(r.isNotNull(), n) for r, n in zip(radii, range(k, 0, -1))])
    near = h.settle(frame.withColumns({"_r": F.coalesce(*radii), "_k": reached}).withColumnRenamed("_k", "_reached"), *sides)
    near = stage(near.filter("_r is not null").select("column", "_y", "x", "_id", "_r", "_reached"), "radii")

    wide, r = F.col("_r") > 0, F.col("_r")
    ends = F.array(
        F.struct(x.alias("v"), F.lit(0).alias("kind"), F.lit(0).alias("sign")),
        # What lies below the upper end, less what lies at or below the lower end; at radius 0 the other way round.
        F.struct((x + r).alias("v"), F.when(wide, -1).otherwise(1).alias("kind"), F.lit(1).alias("sign")),
        F.struct((x - r).alias("v"), F.when(wide, 1).otherwise(-1).alias("kind"), F.lit(-1).alias("sign")),
    )
    marks = near.select("column", "_id", F.inline(ends))
    counted = running(marks, Axis(keys=("column",), ts="v", ties=("kind",), cell=None), _n=total((F.col("sign") == 0).cast("long")))
    within = counted.filter("sign <> 0").groupBy("column", "_id").agg(F.sum(F.col("sign") * F.col("_n")).alias("_m"))
    inner = within.groupBy("column").agg(F.avg(digamma(F.col("_m"))).alias("_within"))
    classes = near.groupBy("column", "_y").agg(F.count(F.lit(1)).alias("_c"), F.sum(digamma(F.col("_reached"))).alias("_d"))
    whole = classes.groupBy("column").agg(F.sum("_c").alias("_n"), F.sum("_d").alias("_d"), F.sum(F.col("_c") * digamma(F.col("_c"))).alias("_s"))
    value = digamma(F.col("_n")) + (F.col("_d") - F.col("_s")) / F.col("_n") - F.col("_within")
    # A row for each column.
    return whole.join(inner, "column").select(F.col("column").alias("feature"), F.greatest(value, F.lit(0.0)).alias("mutual_info"))


def select_mutual_info(df: DataFrame, cols: Sequence[str], label: str, n: int, bins: int | None = 10, k: int = 3) -> list[str]:
    """By bins at quantiles, or by ``k`` neighbours if ``bins`` is None."""
    scores = mutual_info_neighbours(df, cols, label, k) if bins is None else mutual_info_scores(df, cols, label, bins)
    return _top(scores, "mutual_info", n)


def select_auto(df: DataFrame, cols: Sequence[str], label: str, n: int, trees: int = 100) -> list[str]:
    """What forest and ANOVA agree on, filled up by importance; by importance alone if they agree on
    fewer than half."""
    return agreed(select_importance(df, cols, label, n, trees), select_anova(df, cols, label, n), n)


def agreed(first: Sequence[str], second: Sequence[str], n: int) -> list[str]:
    """Up to ``n`` names of ``first``, those also in ``second`` in front; in order of ``first`` if under half are."""
    both = [c for c in first if c in set(second)]
    if len(both) < n // 2:
        return list(first[:n])
    return (both + [c for c in first if c not in set(second)])[:n]


def with_lags(df: DataFrame, cols: Sequence[str], n: int, axis: Axis = BARS) -> DataFrame:
    """Append ``<c>_<t>`` for t = 0..n-1: the value t rows before; rows without all of them go."""
    h = Halo.spread(df, axis, back=n)
    lagged = {f"{c}_{t}": F.lag(c, t).over(h.w) for c in cols for t in range(n)}
    return h.settle(h.frame.withColumns(lagged)).na.drop(subset=list(lagged))


def select_stable(
    df: DataFrame, cols: Sequence[str], label: str, k: int, lags: int = 3, folds: int = 3, trees: int = 50, axis: Axis = BARS
) -> list[tuple[str, float]]:
    """The ``k`` columns of greatest importance, averaged over time steps and summed over the growing
    training sets of forward folds."""
    wide = with_lags(df, cols, lags, axis)
    rows = stage(assembled(walk_forward_folds(wide, folds, axis), [f"{c}_{t}" for c in cols for t in range(lags)]).select("fold", label, "_x"), "folds")
    sums = dict.fromkeys(cols, 0.0)
    for fold in range(1, folds + 1):
        found = _forest(label, trees).fit(rows.filter(F.col("fold") < fold)).featureImportances.toArray()
        for i, c in enumerate(cols):
            sums[c] += float(sum(found[i * lags : (i + 1) * lags])) / lags
    return sorted(sums.items(), key=lambda p: (-p[1], p[0]))[:k]


# Default parameters per kind of model.
DEFAULTS: dict[str, dict[str, Any]] = {
    "random_forest": {"trees": 100, "depth": 6},
    "boosted": {"rounds": 20, "depth": 4, "step": 0.1},
}


def classifier(label: str, weight: str, trees: int, depth: int, **more) -> RandomForestClassifier:
    """A weighted forest over ``_scaled``. Further parameters are Spark's own."""
    return RandomForestClassifier(
        featuresCol="_scaled", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, seed=SEED,
        predictionCol="y_pred", probabilityCol="_probability", rawPredictionCol="_raw", **more,
    )


def train(df: DataFrame, cols: Sequence[str], label: str, kind: str = "random_forest", validation: Column | None = None, **params) -> PipelineModel | BoostedModel:
    """Fit with balanced class weights on the complete rows; everything runs as Spark stages.

    A forest learns from scaled columns and from all rows. Boosting (``boosting.fit``, whose parameters ``params`` are)
    is one softmax over all classes; rows where ``validation`` holds only tell it when to stop.
    """
    usable = df.filter(complete(cols) & F.col(label).isNotNull())
    params = {**DEFAULTS[kind], **params}
    if kind == "boosted":
        learned = usable if validation is None else usable.filter(~F.coalesce(validation, F.lit(False)))
        weights = class_weights(learned, label).select(label, F.col("weight").alias("_weight"))
        return boosting.fit(join_stats(usable, weights, [label], "inner"), cols, label, "_weight", validation, **params)
    if validation is not None:
        usable = usable.filter(~F.coalesce(validation, F.lit(False)))
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="keep"),
        StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True),
        classifier(label, "_weight", **params),
    ]
    return Pipeline(stages=stages).fit(with_class_weight(usable, label, "_weight"))


def score(df: DataFrame, model: PipelineModel | BoostedModel) -> DataFrame:
    """Append ``y_pred``, the class probabilities ``probs`` and their largest as ``confidence``.

    Every row stays; one that lacks a feature gets nulls.
    """
    if isinstance(model, BoostedModel):
        return model.score(df)
    known = complete(model.stages[0].getInputCols())
    scored = model.transform(df).withColumns(
        {"probs": F.when(known, vector_to_array("_probability")), "y_pred": F.when(known, F.col("y_pred").cast("int"))}
    )
    return scored.withColumn("confidence", F.array_max("probs")).select(*df.columns, "y_pred", "probs", "confidence")


def save_model(model: PipelineModel | BoostedModel, path: str) -> None:
    """Write a fitted model, a forest with its scaler, to a folder any session can load it from."""
    if isinstance(model, BoostedModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: str = "random_forest") -> PipelineModel | BoostedModel:
    return BoostedModel.load(SparkSession.getActiveSession(), path) if kind == "boosted" else PipelineModel.load(path)


def window_columns(cols: Sequence[str], length: int) -> list[str]:
    """Names of the flattened window: ``<column>_<step>``, step 0 the newest row."""
    return [f"{c}_{t}" for t in range(length) for c in cols]


def flat_windows(df: DataFrame, cols: Sequence[str], length: int, window: str = "window") -> DataFrame:
    """One column for each step and feature of a window (array of rows), counted from its newest row; null where a window is shorter.

    So windows of equal length (``pad_sequences``) are model input for ``train``, ``score`` and ``smote``.
    """
    at = lambda t, i: F.get(F.get(window, F.size(window) - 1 - t), F.lit(i))
    flat = [at(t, i).alias(f"{c}_{t}") for t in range(length) for i, c in enumerate(cols)]
    return df.select(*[c for c in df.columns if c != window], *flat)


def score_with(df: DataFrame, predict, cols: Sequence[str]) -> DataFrame:
    """Score by a foreign model: ``predict`` takes a 2-D array and returns class probabilities. It runs on
    Arrow batches in the tasks."""
    @pandas_udf("array<double>")
    def probabilities(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(predict(x.to_numpy(dtype="float64"))))

    scored = df.withColumn("probs", probabilities(F.struct(*cols)))
    return with_choice(scored)


def with_choice(df: DataFrame) -> DataFrame:
    """``y_pred`` and ``confidence`` from ``probs``: the first largest probability."""
    top = F.array_max("probs")
    return df.withColumns({"confidence": top, "y_pred": (F.array_position("probs", top) - 1).cast("int")})


def ensemble_mean(df: DataFrame, models: Sequence[PipelineModel | BoostedModel]) -> DataFrame:
    """Score by the mean of the models' probabilities; the models are chained, so rows are never joined."""
    scored = df
    for i, model in enumerate(models):
        extra = score(scored, model).withColumnRenamed("probs", f"_probs_{i}").drop("y_pred", "confidence")
        scored = extra
    parts = [F.col(f"_probs_{i}") for i in range(len(models))]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    mean = F.transform(total, lambda v: v / len(models))
    return with_choice(scored.withColumn("probs", mean).drop(*[f"_probs_{i}" for i in range(len(models))]))


def parameter_draws(space: Mapping[str, Sequence[Any]], trials: int, seed: int = SEED) -> list[dict[str, Any]]:
    """``trials`` different points of the grid, drawn with a fixed seed."""
    grid = [dict(zip(space, values)) for values in product(*space.values())]
    return random.Random(seed).sample(grid, min(trials, len(grid)))


def search(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    kind: str,
    space: Mapping[str, Sequence[Any]],
    trials: int = 4,
    folds: int = 3,
    axis: Axis = BARS,
    parallel: int = 3,
) -> list[tuple[dict[str, Any], float]]:
    """Parameter points of a grid by mean weighted F1 over forward folds, best first.

    The folds are written once; every fit reads only its columns. One number per fit comes back. ``parallel`` points are
    fitted at a time, as Spark jobs side by side.
    """
    rows = stage(walk_forward_folds(df.select(*axis.id, *cols, label), folds, axis), "folds")

    def mean(point: dict[str, Any]) -> float:
        return sum(_fold_score(rows, cols, label, kind, point, fold)[0] for fold in range(1, folds + 1)) / folds

    points = parameter_draws(space, trials)
    with _side_by_side(parallel) as run:
        return sorted(zip(points, run(mean, points)), key=lambda p: -p[1])


@contextlib.contextmanager
def _side_by_side(n: int):
    """A map whose calls run as Spark jobs side by side, in threads that share the session's settings."""
    with ThreadPoolExecutor(n) as pool:
        yield lambda f, items: list(pool.map(inheritable_thread_target(SparkSession.getActiveSession())(f), items))


def _fold_score(rows: DataFrame, cols: Sequence[str], label: str, kind: str, point: Mapping[str, Any], fold: int) -> tuple[float, DataFrame]:
    """Weighted F1 on a forward fold of a fit on the rows before it, and the scored rows."""
    model = train(rows.filter(F.col("fold") < fold), cols, label, kind, **point)
    tested = score(rows.filter(F.col("fold") == fold), model)
    return evaluate(tested, label, "y_pred").first()["f1_score"], tested


@dataclass
class Trial:
    """A point, its F1 by fold as far as it came, and whether it was given up before the last fold."""

    number: int
    params: dict[str, Any]
    scores: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else float("-inf")


class ParzenSampler:
    """Draws points of a space where good trials lie denser than bad ones (a tree-structured Parzen estimator).

    A parameter is a list of choices or a range (low, high) of whole numbers or floats. Finished trials are cut into the
    best ``share`` and the rest; each parameter has a density over either: choices by their counts, numbers by bells around
    the trials' values, as wide as the distance to their neighbours, and one over the whole range. Of ``candidates`` drawn
    from the density of the good ones the one with the largest ratio of both is taken. Pruned trials rank by the folds they
    have, behind all that finished.
    """

    def __init__(self, space: Mapping[str, Any], seed: int = SEED, startup: int = 6, share: float = 0.25, candidates: int = 24):
        self.space, self.random, self.startup, self.share, self.candidates = dict(space), random.Random(seed), startup, share, candidates

    def _range(self, name: str) -> tuple[float, float, bool] | None:
        values = self.space[name]
        if not isinstance(values, tuple):
            return None
        low, high = values
        whole = isinstance(low, int) and isinstance(high, int)
        return (low - 0.5, high + 0.5, True) if whole else (low, high, False)

    def _point(self, draw) -> dict[str, Any]:
        out = {}
        for name, values in self.space.items():
            bounds = self._range(name)
            x = draw(name)
            out[name] = x if bounds is None else min(max(round(x), values[0]), values[1]) if bounds[2] else min(max(x, bounds[0]), bounds[1])
        return out

    def _bells(self, name: str, trials: Sequence[Trial]) -> list[tuple[float, float]]:
        low, high, _ = self._range(name)
        at = sorted(float(t.params[name]) for t in trials)
        edges = [low, *at, high]
        least = (high - low) / min(100, 1 + len(edges))
        wide = [min(max(edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1], least), high - low) for i in range(len(at))]
        return [*zip(at, wide), ((low + high) / 2, high - low)]

    def _draw(self, name: str, good: Sequence[Trial]) -> Any:
        bounds = self._range(name)
        if bounds is None:
            choices = self.space[name]
            return self.random.choices(choices, [1 + sum(t.params[name] == c for t in good) for c in choices])[0]
        centre, width = self.random.choice(self._bells(name, good))
        for _ in range(100):
            x = self.random.gauss(centre, width)
            if bounds[0] <= x <= bounds[1]:
                return x
        return self.random.uniform(bounds[0], bounds[1])

    def _density(self, name: str, x: Any, trials: Sequence[Trial]) -> float:
        bounds = self._range(name)
        if bounds is None:
            return (1 + sum(t.params[name] == x for t in trials)) / (len(self.space[name]) + len(trials))
        bells = self._bells(name, trials)

        def share(a: float, b: float) -> float:
            return (math.erf(b / math.sqrt(2)) - math.erf(a / math.sqrt(2))) / 2

        total = 0.0
        for centre, width in bells:
            inside = share((bounds[0] - centre) / width, (bounds[1] - centre) / width)
            total += math.exp(-(((x - centre) / width) ** 2) / 2) / width / inside
        return total / len(bells)

    def suggest(self, finished: Sequence[Trial]) -> dict[str, Any]:
        """The next point, given the finished trials."""
        if len(finished) < self.startup:
            return self._point(lambda n: self.random.choice(self.space[n]) if self._range(n) is None else self.random.uniform(*self._range(n)[:2]))
        ranked = sorted(finished, key=lambda t: (t.pruned, -len(t.scores), -t.mean, t.number))
        cut = max(1, math.ceil(self.share * len(ranked)))
        good, bad = ranked[:cut], ranked[cut:]
        points = [self._point(lambda n: self._draw(n, good)) for _ in range(self.candidates)]

        def ratio(point: dict[str, Any]) -> float:
            return sum(math.log(self._density(n, x, good) / self._density(n, x, bad)) for n, x in point.items())

        return max(points, key=ratio)


def guided_search(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    kind: str,
    space: Mapping[str, Any],
    trials: int = 16,
    folds: int = 3,
    parallel: int = 4,
    axis: Axis = BARS,
    seed: int = SEED,
    startup: int = 6,
    path: str | None = None,
) -> list[Trial]:
    """Trials of ``space`` (see ``ParzenSampler``), best first, each drawn from what the trials of earlier batches scored.

    A batch of ``parallel`` trials runs at a time. After a fold, a trial whose mean so far is below the median of what the
    trials of earlier batches had after as many folds is given up. With ``path`` the scored rows of each fold are written
    there, by trial and fold, with the label and y_pred they were judged by. Same data and seed, same trials, whatever
    order the jobs of a batch end in.
    """
    rows = stage(walk_forward_folds(df.select(*axis.id, *cols, label), folds, axis), "folds")
    sampler, finished = ParzenSampler(space, seed, startup), []

    def run(trial: Trial) -> Trial:
        for fold in range(1, folds + 1):
            value, tested = _fold_score(rows, cols, label, kind, trial.params, fold)
            if path:
                kept = tested.select(*axis.id, label, "y_pred")
                kept.write.mode("overwrite").parquet(f"{path}/trial={trial.number}/part={fold}")
            trial.scores.append(value)
            before = [sum(t.scores[:fold]) / fold for t in earlier if len(t.scores) >= fold]
            if fold < folds and before and trial.mean < statistics.median(before):
                trial.pruned = True
                break
        return trial

    with _side_by_side(parallel) as side_by_side:
        while len(finished) < trials:
            earlier = list(finished)
            size = min(parallel, trials - len(finished))
            # Points of one batch are all drawn from the trials before it.
            batch = [Trial(len(finished) + i, sampler.suggest(earlier)) for i in range(size)]
            finished += side_by_side(run, batch)
    return sorted(finished, key=lambda t: (t.pruned, -len(t.scores), -t.mean, t.number))


# Model registry -----------------------------------------------------------------------------------------

REGISTRY = (
    "version string, model_type string, created_at timestamp_ntz, config string, metrics map<string,double>, "
    "feature_names array<string>, data_hash string, model_path string, description string"
)


def version_id(model_type: Column, created_at: Column, data_hash: Column) -> Column:
    """<type>_<yyyyMMdd>_<HHmmss>_<first 8 digits of the hash of the data hash>."""
    stamp = F.date_format(created_at, "yyyyMMdd_HHmmss")
    return F.concat_ws("_", model_type, stamp, F.substring(F.md5(data_hash), 1, 8))


def registry_append(entries: DataFrame, path: str) -> None:
    """Add versions to the registry table; entries follow the ``REGISTRY`` schema."""
    key = version_id(F.col("model_type"), F.col("created_at"), F.col("data_hash"))
    entries.withColumn("version_id", key).write.mode("append").parquet(path)


def register(model: PipelineModel | BoostedModel, path: str, version: str, model_type: str, created_at: str, metrics: Mapping[str, float], cols: Sequence[str], data_hash: str, description: str = "", config: str = "{}") -> None:
    """Save a model below ``path``/models and add its version, with where it lies, to the registry ``path``/versions."""
    spark = SparkSession.getActiveSession()
    where = f"{path}/models/{version}"
    save_model(model, where)
    entry = [(version, model_type, config, dict(metrics), list(cols), data_hash, where, description)]
    schema = "version string, model_type string, config string, metrics map<string,double>, feature_names array<string>, data_hash string, model_path string, description string"
    rows = spark.createDataFrame(entry, schema).withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))
    registry_append(rows, f"{path}/versions")


def load_best(spark: SparkSession, path: str, metric: str = "f1_score") -> PipelineModel | BoostedModel:
    """The registered model with the largest ``metric``; ValueError if there is none."""
    models = registry(spark, f"{path}/versions")
    best = best_model(models, metric).join(models.select("version_id", "model_path"), "version_id").select("model_path", "model_type").first()
    if best is None:
        raise ValueError(f"no registered version has {metric}")
    return load_model(best["model_path"], best["model_type"])


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get_model(models: DataFrame, key: str) -> DataFrame:
    return models.filter(F.col("version_id") == key)


def best_model(models: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The version with the largest value of ``metric`` (over -1); the earliest of equals."""
    value = models.withColumn("_value", F.col("metrics")[metric]).filter("_value > -1")
    best = F.min_by(
        F.struct("version_id", "model_type", F.col("_value").alias("value")),
        F.struct((-F.col("_value")).alias("v"), "created_at", "version_id"),
    )
    return value.agg(best.alias("_b")).filter("_b is not null").select("_b.*")
