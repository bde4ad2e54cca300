"""Queries on column selection, training, evaluation and the model registry."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.indicators import FEATURES, bars, simple_state_sql
from tidemark.fixtures import bars30, table, vectors
from tidemark.operators import evaluation as V
from tidemark.operators import indicators as X
from tidemark.operators import training as T
from tidemark.operators.clean import adaptive_null_fix, strip_zero_bars
from tidemark.plans.series import BARS, Halo, numbered
from tidemark.session import new_path, stage

# Predictions: the regime of the next bar against this bar's; scores from the bar, rounded so that ties occur.
PREDS = f"""{bars()}, st AS (SELECT symbol, ts, rn, open, close, {simple_state_sql()} AS y_pred FROM b),
  preds AS (SELECT * FROM (SELECT symbol, ts, y_pred, lead(y_pred) OVER (PARTITION BY symbol ORDER BY rn) AS y_true, R2(close / (open + close)) AS p2,
            R2(open / (open + close) / 2) AS p1, R2(open / (open + close) / 2) AS p0 FROM st) WHERE y_true IS NOT NULL)"""


def preds(spark, sf):
    states = X.market_state_simple(bars30(spark, sf).select("symbol", "ts", "open", "close"), "y_pred")
    h = Halo.spread(states, BARS, ahead=1)
    rows = h.settle(h.frame.withColumn("y_true", F.lead("y_pred").over(h.w))).filter("y_true is not null")
    share, half = F.col("close") / (F.col("open") + F.col("close")), F.col("open") / (F.col("open") + F.col("close")) / 2
    return rounded(rows.select("symbol", "ts", "y_true", "y_pred", half.alias("p0"), half.alias("p1"), share.alias("p2")), "p0", "p1", "p2", digits=2)


@query(
    "confusion_matrix",
    f"""WITH {PREDS} SELECT y_true, count(*) FILTER (WHERE y_pred = 0) AS pred_0, count(*) FILTER (WHERE y_pred = 1) AS pred_1,
        count(*) FILTER (WHERE y_pred = 2) AS pred_2 FROM preds GROUP BY 1""",
    ("bars30",),
)
def _(spark, sf):
    return V.confusion_matrix(preds(spark, sf))


REPORT = """rep0 AS (SELECT c AS label, count(*) FILTER (WHERE y_true = c) AS support, count(*) FILTER (WHERE y_pred = c) AS chosen,
    count(*) FILTER (WHERE y_true = c AND y_pred = c) AS hit FROM preds, (VALUES (0), (1), (2)) t(c) GROUP BY 1),
  rep AS (SELECT label, coalesce(hit / nullif(chosen, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
    coalesce(2 * hit / nullif(chosen + support, 0), 0) AS f1, support FROM rep0)"""


@query(
    "class_report",
    f"WITH {PREDS}, {REPORT} SELECT label, R(precision) AS precision, R(recall) AS recall, R(f1) AS f1, support FROM rep",
    ("bars30",),
)
def _(spark, sf):
    return rounded(V.class_report(preds(spark, sf)), "precision", "recall", "f1")


@query(
    "evaluate",
    f"""WITH {PREDS}, {REPORT} SELECT R((SELECT avg((y_true = y_pred)::INT) FROM preds)) AS accuracy, R(sum(precision * support) / sum(support)) AS precision,
        R(sum(recall * support) / sum(support)) AS recall, R(sum(f1 * support) / sum(support)) AS f1_score, sum(support)::BIGINT AS rows FROM rep""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(V.evaluate(preds(spark, sf)), "accuracy", "precision", "recall", "f1_score")


AUC = """long AS (SELECT 0 AS label, p0 AS s, y_true = 0 AS hit FROM preds UNION ALL SELECT 1, p1, y_true = 1 FROM preds UNION ALL SELECT 2, p2, y_true = 2 FROM preds),
  auc AS (SELECT label, sum(hit::INT * (r + (c - 1) / 2)) AS ranks, sum(hit::INT) AS p, sum((NOT hit)::INT) AS n FROM (
    SELECT label, hit, rank() OVER (PARTITION BY label ORDER BY s) AS r, count(*) OVER (PARTITION BY label, s) AS c FROM long) GROUP BY 1)"""


@query("auc_by_class", f"WITH {PREDS}, {AUC} SELECT label, R((ranks - p * (p + 1) / 2) / (p * n)) AS auc FROM auc", ("bars30",))
def _(spark, sf):
    return rounded(V.auc_by_class(preds(spark, sf), ["p0", "p1", "p2"]), "auc")


@query("auc_ovr", f"WITH {PREDS}, {AUC} SELECT R(avg((ranks - p * (p + 1) / 2) / (p * n))) AS auc FROM auc", ("bars30",))
def _(spark, sf):
    return rounded(V.auc_ovr(preds(spark, sf), ["p0", "p1", "p2"]), "auc")


@query(
    "neutral_f1",
    f"""WITH {PREDS} SELECT R(2 * count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) / (count(*) FILTER (WHERE y_true = 1) + count(*) FILTER (WHERE y_pred = 1))) AS neutral_f1
        FROM preds""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(V.neutral_f1(preds(spark, sf)), "neutral_f1")


DIMS = 64
_X = [f"x{i:02d}" for i in range(DIMS)]


def dims(spark, sf):
    return vectors(spark, sf).select("vec_id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(_X)])


@query(
    "select_anova",
    """WITH long AS (SELECT label, 'x' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, features[i] AS x FROM vectors, range(1, 65) t(i)),
       c AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
       g AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM c)
       SELECT feature, R((sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))) AS f_value FROM g GROUP BY 1""",
    ("vectors",),
)
def _(spark, sf):
    return rounded(T.anova_scores(dims(spark, sf), _X, "label"), "f_value")


@query(
    "select_mutual_info",
    """WITH long AS (SELECT label, 'x' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, features[i] AS x FROM vectors, range(1, 65) t(i)),
       q AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM long GROUP BY 1),
       c AS (SELECT feature, len([k for k in cuts if k < x]) AS bin, label, count(*) AS n FROM long JOIN q USING (feature) GROUP BY 1, 2, 3),
       s AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS w, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS ny FROM c)
       SELECT feature, R(sum(n / w * ln(n * w / (nb * ny)))) AS mutual_info FROM s GROUP BY 1""",
    ("vectors",),
)
def _(spark, sf):
    return rounded(T.mutual_info_scores(stage(dims(spark, sf), "dims"), _X, "label"), "mutual_info")


@query(
    "mutual_info_neighbours",
    """WITH long AS (SELECT vec_id, label, 'x' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, features[i]::DOUBLE AS x FROM vectors, range(1, 65) t(i)),
       c AS (SELECT label, count(*) AS nc, least(3, count(*) - 1) AS k FROM vectors GROUP BY 1 HAVING count(*) > 1),
       r AS (SELECT a.feature, a.vec_id, any_value(a.x) AS x, any_value(k) AS k, any_value(nc) AS nc, list_sort(list(abs(a.x - b.x)))[any_value(k)] AS r
             FROM long a JOIN long b ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id JOIN c ON c.label = a.label GROUP BY 1, 2),
       m AS (SELECT a.feature, a.vec_id, any_value(a.k) AS k, any_value(a.nc) AS nc, count(*) AS m FROM r a JOIN r b ON a.feature = b.feature
               AND ((b.x > a.x - a.r AND b.x < a.x + a.r) OR (a.r = 0 AND b.x = a.x)) GROUP BY 1, 2),
       h AS (SELECT n, coalesce(sum(1::DOUBLE / nullif(n - 1, 0)) OVER (ORDER BY n), 0) - 0.5772156649015329 AS d FROM range(1, (SELECT count(*) + 1 FROM vectors)::BIGINT) t(n))
       SELECT feature, R(greatest((SELECT d FROM h WHERE n = (SELECT sum(nc) FROM c)) + avg(hk.d) - avg(hc.d) - avg(hm.d), 0)) AS mutual_info
       FROM m JOIN h hk ON hk.n = m.k JOIN h hc ON hc.n = m.nc JOIN h hm ON hm.n = m.m GROUP BY 1""",
    ("vectors",),
)
def _(spark, sf):
    """Mutual information of class and component from neighbours along the component."""
    return rounded(T.mutual_info_neighbours(dims(spark, sf), _X, "label"), "mutual_info")


def features(spark, sf):
    """Base features without nulls and the two-mean regime as label."""
    bars_ = stage(strip_zero_bars(bars30(spark, sf)), "bars")
    base = stage(X.base_features(bars_).drop("market_state"), "features")
    labeled = X.market_state_simple(adaptive_null_fix(base, X.BASE_FEATURES), "label")
    return stage(labeled.select("symbol", "ts", "label", *X.BASE_FEATURES), "labeled")


def ranked(spark, pairs):
    return spark.createDataFrame([(i + 1, c, float(v)) for i, (c, v) in enumerate(pairs)], "place int, feature string, value double")


@query("select_importance")
def _(spark, sf):
    return ranked(spark, T.importances(features(spark, sf), X.BASE_FEATURES, "label")[:5])


@query("select_auto")
def _(spark, sf):
    chosen = T.select_auto(features(spark, sf), X.BASE_FEATURES, "label", 5)
    return ranked(spark, [(c, i) for i, c in enumerate(chosen)])


@query("select_stable")
def _(spark, sf):
    return ranked(spark, T.select_stable(features(spark, sf), X.BASE_FEATURES, "label", 4))


def split(df):
    from tidemark.operators.sampling import time_split

    return stage(time_split(df), "split")


@query("train_random_forest")
def _(spark, sf):
    """Scores of a weighted forest on the last fifth of every series."""
    rows = split(features(spark, sf))
    model = T.train(rows.filter("split = 'train'"), X.BASE_FEATURES, "label")
    return V.evaluate(T.score(rows.filter("split = 'test'"), model), "label")


@query("train_boosted")
def _(spark, sf):
    """Scores of softmax boosting on the last fifth of every series, stopped by the loss on the rows before."""
    rows = split(features(spark, sf))
    model = T.train(rows.filter("split <> 'test'"), X.BASE_FEATURES, "label", "boosted", validation=F.col("split") == "val")
    return V.evaluate(T.score(rows.filter("split = 'test'"), model), "label")


# One round of softmax boosting at depth 1: all classes are equally likely before it, so a row's gradient is its weight times
# 1/K - (class is k) and its hessian weight/K * (1 - 1/K). Cuts are eighths of a column, the first of the best ones counts.
BOOSTED = """cw AS (SELECT label, (SELECT count(*) FROM vectors) / ((SELECT count(DISTINCT label) FROM vectors) * count(*)) AS w FROM vectors GROUP BY 1),
  kk AS (SELECT label AS k, (SELECT count(*) FROM cw) AS kn FROM cw),
  long AS (SELECT vec_id, label, i - 1 AS col, features[i] AS x FROM vectors, range(1, 65) t(i)),
  q AS (SELECT col, unnest(list_distinct(quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS cut FROM long GROUP BY 1),
  sums AS (SELECT col, cut, label, sum(w) FILTER (x <= cut) AS lw, sum(w) AS tw, count(*) FILTER (x <= cut) AS ln, count(*) AS tn FROM q JOIN long USING (col) JOIN cw USING (label) GROUP BY 1, 2, 3),
  gh AS (SELECT col, cut, k, sum(coalesce(lw, 0) * (1 / kn - (label = k)::INT)) AS lg, sum(tw * (1 / kn - (label = k)::INT)) AS tg, sum(coalesce(lw, 0) / kn * (1 - 1 / kn)) AS lh,
           sum(tw / kn * (1 - 1 / kn)) AS th, sum(ln) AS ln, sum(tn) AS tn FROM sums, kk GROUP BY 1, 2, 3),
  gain AS (SELECT *, round((lg * lg / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg * tg / (th + 1)) / 2, 9) AS gain FROM gh WHERE ln >= 1 AND tn - ln >= 1),
  top AS (SELECT * FROM gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, col, cut) = 1),
  m AS (SELECT vec_id, long.label, k, 0.5 * CASE WHEN x <= cut THEN -lg / (lh + 1) ELSE -(tg - lg) / (th - lh + 1) END AS margin FROM long JOIN top USING (col)),
  p AS (SELECT vec_id, label, k, exp(margin) / sum(exp(margin)) OVER (PARTITION BY vec_id) AS p FROM m)"""


@query(
    "boosted_stump",
    f"WITH {BOOSTED} SELECT vec_id, label, arg_max(k, p ORDER BY round(p, 12) DESC, k) AS y_pred, R(max(p)) AS confidence, R(sum(p * k)) AS mean_class FROM p GROUP BY 1, 2",
    ("vectors",),
)
def _(spark, sf):
    """Predictions of one round of one cut for each class."""
    rows = stage(dims(spark, sf), "dims")
    model = T.train(rows, _X, "label", "boosted", rounds=1, depth=1, step=0.5, bins=8)
    scored = T.score(rows, model)
    mean = F.aggregate(F.zip_with("probs", F.array(*[F.lit(float(c)) for c in model.classes]), lambda p, c: p * c), F.lit(0.0), lambda a, v: a + v)
    return rounded(scored.select("vec_id", "label", "y_pred", "confidence", mean.alias("mean_class")), "confidence", "mean_class")


@query("score")
def _(spark, sf):
    """Predicted class, probabilities and confidence of the last fifth of every series."""
    rows = split(features(spark, sf))
    scored = T.score(rows.filter("split = 'test'"), T.train(rows.filter("split = 'train'"), X.BASE_FEATURES, "label"))
    probs = [F.col("probs")[i].alias(f"p{i}") for i in range(3)]
    return scored.select("symbol", "ts", "label", "y_pred", "confidence", *probs)


@query(
    "score_with",
    f"""WITH {bars()}, s AS (SELECT symbol, ts, 1 / (1 + exp(-(close - open) / 10)) AS up FROM b)
        SELECT symbol, ts, R(greatest(up, 1 - up)) AS confidence, CASE WHEN up > 1 - up THEN 1 ELSE 0 END AS y_pred FROM s""",
    ("bars30",),
)
def _(spark, sf):
    def predict(x):
        import numpy as np

        up = 1 / (1 + np.exp(-(x[:, 1] - x[:, 0]) / 10))
        return np.stack([1 - up, up], axis=1)

    scored = T.score_with(bars30(spark, sf).select("symbol", "ts", "open", "close"), predict, ["open", "close"])
    return rounded(scored.select("symbol", "ts", "confidence", "y_pred"), "confidence")


@query("ensemble_mean")
def _(spark, sf):
    """Two forward training sets, one forest each, scored by their mean."""
    from tidemark.operators.sampling import walk_forward_folds

    rows = stage(walk_forward_folds(features(spark, sf), 2), "folds")
    models = [T.train(rows.filter(F.col("fold") < f), X.BASE_FEATURES, "label") for f in (1, 2)]
    scored = T.ensemble_mean(rows.filter("fold = 2"), models)
    return scored.select("symbol", "ts", "label", "y_pred", "confidence")


@query("search")
def _(spark, sf):
    """Mean weighted F1 over forward folds of every point of the grid."""
    found = T.search(
        features(spark, sf), X.BASE_FEATURES, "label", "random_forest", {"trees": [10, 20, 40], "depth": [3, 5, 7]}, trials=9, folds=3
    )
    return spark.createDataFrame(
        [(i + 1, p["trees"], p["depth"], s) for i, (p, s) in enumerate(found)], "place int, trees int, depth int, f1_score double"
    )


@query("guided_search")
def _(spark, sf):
    """Trials drawn by what earlier ones scored; weak ones given up after a fold."""
    found = T.guided_search(
        features(spark, sf), X.BASE_FEATURES, "label", "random_forest", {"trees": (5, 40), "depth": (2, 8), "minInfoGain": (0.0, 0.05), "featureSubsetStrategy": ["sqrt", "all"]},
        trials=10, folds=3, parallel=4, startup=4,
    )
    rows = [(i + 1, t.number, t.params["trees"], t.params["depth"], t.params["featureSubsetStrategy"], len(t.scores), t.pruned, t.mean) for i, t in enumerate(found)]
    return spark.createDataFrame(rows, "place int, number int, trees int, depth int, columns string, folds int, pruned boolean, f1_score double")


@query(
    "score_with_nulls",
    f"""WITH RECURSIVE {FEATURES}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM features)
        SELECT symbol, ts, rn % 17 <> 5 AS scored FROM n""",
    ("bars30",),
)
def _(spark, sf):
    """Every row comes back; those that lack a feature without a prediction."""
    rows = stage(features(spark, sf), "rows")
    model = T.train(rows, X.BASE_FEATURES, "label", trees=5)
    hole = F.when(F.col("rn") % 17 != 5, F.col("atr"))
    holed = numbered(rows, BARS).withColumn("atr", hole).drop("rn")
    return T.score(holed, model).select("symbol", "ts", (F.col("y_pred").isNotNull() & F.col("confidence").isNotNull()).alias("scored"))


def windows(spark, sf, length=10):
    """Full windows of close and volume as columns, with the regime of the newest row."""
    from tidemark.operators.sampling import sequences_fixed

    rows = bars30(spark, sf).select("symbol", "ts", "open", "close", "volume")
    labels = X.market_state_simple(rows, "label").select("symbol", "ts", "label")
    made = sequences_fixed(rows, ["close", "volume"], length).join(labels, ["symbol", "ts"])
    return stage(T.flat_windows(made, ["close", "volume"], length), "windows")


@query(
    "flat_windows",
    """WITH n AS (SELECT *, row_number() OVER w AS rn, lag(close, 9) OVER w AS old_close, lag(volume, 3) OVER w AS some_volume FROM bars30 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
       SELECT symbol, ts, R(close) AS close_0, volume::DOUBLE AS volume_0, R(old_close) AS close_9, some_volume::DOUBLE AS volume_3 FROM n WHERE rn >= 10""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(windows(spark, sf).select("symbol", "ts", "close_0", "volume_0", "close_9", "volume_3"), "close_0", "close_9")


@query(
    "register_and_score",
    """WITH n AS (SELECT symbol, count(*) - 9 AS n FROM bars30 GROUP BY 1 HAVING count(*) > 9)
       SELECT symbol, (n - floor(n * (1 - 0.2)::DOUBLE))::BIGINT AS rows, (n - floor(n * (1 - 0.2)::DOUBLE))::BIGINT AS scored, 'random_forest_20240101_000000_' || substr(md5('bars30'), 1, 8) AS version_id FROM n""",
    ("bars30",),
)
def _(spark, sf):
    """Train on flattened windows, save, register, load the best version and score the last fifth."""
    rows, cols, path = split(windows(spark, sf)), T.window_columns(["close", "volume"], 10), new_path(spark, "registry")
    for version, trees, value in (("a", 1, 0.1), ("b", 10, 0.5)):
        model = T.train(rows.filter("split = 'train'"), cols, "label", trees=trees)
        T.register(model, path, version, "random_forest", "2024-01-01 00:00:00", {"f1_score": value}, cols, "bars30")
    scored = T.score(rows.filter("split = 'test'"), T.load_best(spark, path))
    best = T.best_model(T.registry(spark, f"{path}/versions")).select("version_id")
    counts = scored.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("y_pred").isNotNull() & (F.size("probs") == 3)).alias("scored"))
    return counts.crossJoin(F.broadcast(best))


# The best first split, by Gini impurity over rows that weigh as much as their class is rare. Values have one decimal.
STUMP = """long AS (SELECT vec_id, label, 'x' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, round(features[i], 1) AS x FROM vectors, range(1, 65) t(i)),
  cw AS (SELECT label, (SELECT count(*) FROM vectors) / ((SELECT count(DISTINCT label) FROM vectors) * count(*)) AS w FROM vectors GROUP BY 1),
  cnt AS (SELECT feature, x, label, sum({w}) AS n FROM long JOIN cw USING (label) GROUP BY 1, 2, 3),
  grid AS (SELECT f.feature, f.x, l.label FROM (SELECT DISTINCT feature, x FROM cnt) f, (SELECT DISTINCT label FROM vectors) l),
  cum AS (SELECT feature, x, label, sum(coalesce(n, 0)) OVER (PARTITION BY feature, label ORDER BY x) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY feature, label) AS t FROM grid LEFT JOIN cnt USING (feature, x, label)),
  cut AS (SELECT feature, x, sum(l) AS ls, sum(t - l) AS rs, sum(l * l) / nullif(sum(l), 0) + sum((t - l) ** 2) / nullif(sum(t - l), 0) AS purity FROM cum GROUP BY 1, 2),
  top AS (SELECT feature, x FROM cut WHERE purity IS NOT NULL ORDER BY purity DESC, feature, x LIMIT 1)"""


def coarse(spark, sf):
    return dims(spark, sf).withColumns({c: F.round(c, 1) for c in _X})


@query("importance_of_stump", f"WITH {STUMP.format(w='1.0')} SELECT feature, 1.0::DOUBLE AS importance FROM top", ("vectors",))
def _(spark, sf):
    """A forest of one tree with one split: all importance is that of the best split."""
    found = T.importances(coarse(spark, sf), _X, "label", trees=1, depth=1, bootstrap=False, featureSubsetStrategy="all")
    return spark.createDataFrame([(c, v) for c, v in found if v > 0], "feature string, importance double")


@query(
    "train_stump",
    f"""WITH {STUMP.format(w='w')}, side AS (SELECT vec_id, label, l.x <= top.x AS low FROM long l JOIN top USING (feature)),
        leaf AS (SELECT low, arg_max(label, n ORDER BY n DESC, label) AS y_pred FROM (SELECT low, label, sum(w) AS n FROM side JOIN cw USING (label) GROUP BY 1, 2) GROUP BY 1)
        SELECT vec_id, label, y_pred FROM side JOIN leaf USING (low)""",
    ("vectors",),
)
def _(spark, sf):
    """Predictions of a weighted forest of one tree with one split."""
    rows = stage(coarse(spark, sf), "coarse")
    model = T.train(rows, _X, "label", trees=1, depth=1, bootstrap=False, featureSubsetStrategy="all")
    return T.score(rows, model).select("vec_id", "label", "y_pred")


@query(
    "select_agreed",
    """WITH long AS (SELECT label, 'x' || lpad((i - 1)::VARCHAR, 2, '0') AS feature, features[i] AS x FROM vectors, range(1, 65) t(i)),
       c AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
       g AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM c),
       a AS (SELECT feature, row_number() OVER (ORDER BY (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) DESC, feature) AS r FROM g GROUP BY 1),
       b AS (SELECT feature, row_number() OVER (ORDER BY sum(abs(m)) DESC, feature) AS r FROM c GROUP BY 1),
       j AS (SELECT b.feature, b.r, a.r <= 20 AS agreed FROM b JOIN a USING (feature) WHERE b.r <= 20),
       k AS (SELECT *, count(*) FILTER (agreed) OVER () AS hits FROM j),
       o AS (SELECT feature, row_number() OVER (ORDER BY CASE WHEN hits >= 10 AND NOT agreed THEN 1 ELSE 0 END, r) AS place FROM k)
       SELECT place::INT AS place, feature FROM o""",
    ("vectors",),
)
def _(spark, sf):
    """The choice among two rankings, here by ANOVA and by the size of the class means."""
    rows = stage(dims(spark, sf), "dims")
    means = rows.groupBy("label").agg(*[F.abs(F.avg(c)).alias(c) for c in _X]).agg(*[F.sum(c).alias(c) for c in _X]).first()
    by_size = sorted(_X, key=lambda c: (-means[c], c))
    chosen = T.agreed(by_size[:20], T.select_anova(rows, _X, "label", 20), 20)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "place int, feature string")


def versions(spark, sf):
    """One model version per user: type, time and metrics from its events."""
    events = table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "boosted").otherwise("random_forest")
    entries = events.groupBy("user_id").agg(
        F.max("ts").alias("created_at"), F.round(F.avg("value") / 100, 2).alias("f1"), F.round(F.min("value"), 2).alias("loss")
    )
    metrics = F.create_map(F.lit("f1_score"), F.col("f1"), F.lit("loss"), F.col("loss"))
    entries = entries.select(
        F.col("user_id").cast("string").alias("version"),
        kind.alias("model_type"),
        "created_at",
        F.lit("{}").alias("config"),
        metrics.alias("metrics"),
        F.array(F.lit("rsi"), F.lit("atr")).alias("feature_names"),
        F.concat(F.lit("data-"), F.col("user_id")).alias("data_hash"),
        F.lit("").alias("model_path"),
        F.lit("").alias("description"),
    )
    path = new_path(spark, "registry")
    T.registry_append(entries, path)
    return T.registry(spark, path)


VERSIONS = """v AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'boosted' ELSE 'random_forest' END AS model_type, max(ts) AS created_at,
    round(avg(value) / 100, 2) AS f1, min(value) AS loss FROM events GROUP BY user_id),
  versions AS (SELECT model_type || '_' || strftime(created_at, '%Y%m%d_%H%M%S') || '_' || substr(md5('data-' || user_id), 1, 8) AS version_id, * FROM v)"""


@query("registry_list", f"WITH {VERSIONS} SELECT version_id, model_type, created_at, f1 AS f1_score FROM versions")
def _(spark, sf):
    return versions(spark, sf).select("version_id", "model_type", "created_at", F.col("metrics")["f1_score"].alias("f1_score"))


@query("registry_best", f"WITH {VERSIONS} SELECT version_id, model_type, f1 AS value FROM versions ORDER BY f1 DESC, created_at, version_id LIMIT 1")
def _(spark, sf):
    return T.best_model(versions(spark, sf))


@query("registry_get", f"WITH {VERSIONS} SELECT version_id, f1 AS f1_score, loss FROM versions WHERE version_id = (SELECT max(version_id) FROM versions)")
def _(spark, sf):
    models = versions(spark, sf)
    last = models.agg(F.max("version_id").alias("k")).first()["k"]
    return T.get_model(models, last).select("version_id", F.col("metrics")["f1_score"].alias("f1_score"), F.col("metrics")["loss"].alias("loss"))
