"""Training windows, scaling, splits and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import normal_quantile
from tidemark.plans.neighbours import nearest
from tidemark.plans.parts import join_stats
from tidemark.plans.quantiles import quantile_columns, value_ranks
from tidemark.plans.series import BARS, Axis, Halo, numbered
from tidemark.session import stage

MIN_WINDOW, MAX_WINDOW, BASE_WINDOW = 30, 120, 60


def dynamic_window_size(volatility: Column, trend: Column, base: int = BASE_WINDOW, low: int = MIN_WINDOW, high: int = MAX_WINDOW) -> Column:
    """base x volatility factor x trend factor, as a whole number within ``low``..``high``."""
    factor = F.when(volatility > 0.03, 0.7).when(volatility > 0.015, 0.85).when(volatility > 0, 1.2).otherwise(1.0)
    size = F.floor(F.lit(base) * factor * (0.8 + 0.4 * trend)).cast("int")
    return F.least(F.greatest(size, F.lit(low)), F.lit(high))


def stepped_window_size(volatility: Column, base: int = BASE_WINDOW) -> Column:
    """The older rule: half of ``base`` in high volatility, three quarters in medium."""
    return F.when(volatility > 0.03, int(base * 0.5)).when(volatility > 0.015, int(base * 0.75)).otherwise(base)


def _return(h: Halo) -> Column:
    return F.col("close") / F.nullif(F.lag("close").over(h.w), F.lit(0.0)) - 1


def _collected(h: Halo, cols: Sequence[str], n: int, last: int) -> Column:
    """The rows n..last before this one as an array of feature arrays."""
    return F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(h.w.rowsBetween(-n, last))


def sequences(
    df: DataFrame, cols: Sequence[str], label: str = "market_state", stride: int = 1, base: int = BASE_WINDOW, axis: Axis = BARS
) -> DataFrame:
    """(keys, ts, label, size, window): the rows before each row, as many as volatility and trend ask for.

    Starts at position ``base`` and leaves the last row out; windows shorter than the minimum go.
    """
    h = Halo.exact(df.select(*axis.id, *dict.fromkeys(["close", label, *cols])), axis, back=MAX_WINDOW + 1)
    frame = h.frame.withColumn("_ret", _return(h))
    short, long = F.avg("close").over(h.last(7)), F.avg("close").over(h.last(14))
    volatility = F.when(F.count("_ret").over(h.last(20)) >= 5, F.stddev_samp("_ret").over(h.last(20)))
    frame = frame.withColumns(
        {
            "_vol": F.coalesce(volatility, F.lit(0.0)),
            "_trend": F.when(F.col("_rn") >= 14, F.abs(short - long) / F.nullif(long, F.lit(0.0))),
        }
    )
    place = F.col("_rn") - 1
    wanted = (place >= base) & (place < F.col("_rows") - 1) & ((place - base) % stride == 0)
    size = dynamic_window_size(F.col("_vol"), F.coalesce(F.col("_trend"), F.lit(0.5)), base)
    return _windows(h, frame.withColumns({"_wanted": wanted, "_size": size}), cols, label, MAX_WINDOW, 1)


def _windows(h: Halo, frame: DataFrame, cols: Sequence[str], label: str, reach: int, skip: int) -> DataFrame:
    """For each own row of a block with ``_wanted`` the ``_size`` rows that end ``skip`` rows before it, at most the ``reach``
    rows before this row allow. A block's rows are put into one array, and wanted rows take slices of it, so a row
    that isn't wanted costs nothing and no frame is collected for each row. Windows shorter than the minimum go."""
    values = F.array(*[F.col(c).cast("double") for c in cols])
    row = F.struct("_k", values.alias("values"))
    kept = F.col("_core") & F.col("_wanted")
    start = F.struct("_k", F.col("_size").cast("int").alias("size"), *h.axis.order, F.col(label).alias("label"))
    blocks = frame.groupBy(*h.axis.keys, "_block").agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda r: r["values"]).alias("_rows_of_block"),
        F.collect_list(F.when(kept, start)).alias("_starts"),
    )

    def window(s: Column) -> Column:
        # Rows there are between the reach and the skipped ones; positions start at 1.
        place = s["_k"].cast("int")
        there = F.greatest(F.least(place - skip, F.lit(reach + 1 - skip)), F.lit(0))
        size = F.least(s["size"], there)
        rows = F.slice("_rows_of_block", F.greatest(place - skip - size + 1, F.lit(1)), F.greatest(size, F.lit(0)))
        return F.struct(*[s[c].alias(c) for c in h.axis.order], s["label"].alias("label"), size.alias("size"), rows.alias("window"))

    each = blocks.select(*h.axis.keys, F.explode(F.transform("_starts", window)).alias("_w"))
    return each.select(*h.axis.keys, "_w.*").filter(F.col("size") >= MIN_WINDOW).select(*h.axis.id, "label", "size", "window")


def sequences_next(
    df: DataFrame, cols: Sequence[str], label: str = "market_state", base: int = BASE_WINDOW, axis: Axis = BARS
) -> DataFrame:
    """As ``sequences`` with the stepped sizes, labelled (and stamped) by the row after."""
    numbered_rows = numbered(df.select(*axis.id, *dict.fromkeys(["close", label, *cols])), axis, "_rn", size="_rows")
    # The label of row i+1 belongs to the window that ends before row i: frames are shifted by one row.
    h = Halo.exact(numbered_rows, axis, back=MAX_WINDOW + 2)
    frame = h.frame.withColumn("_ret", _return(h))
    volatility = F.when(F.count("_ret").over(h.last(30)) >= 10, F.stddev_samp("_ret").over(h.last(30)))
    frame = frame.withColumn("_vol", F.when(F.col("_rows") > 30, volatility))
    frame = frame.withColumn("_size", F.lag(stepped_window_size(F.col("_vol"), base)).over(h.w))
    place = F.col("_rn") - 2
    size = F.greatest(F.lit(MIN_WINDOW), F.least(F.col("_size").cast("bigint"), place))
    return _windows(h, frame.withColumns({"_size": size, "_wanted": place >= base}), cols, label, base + 1, 2)


def sequences_fixed(df: DataFrame, cols: Sequence[str], n: int = BASE_WINDOW, finite_share: float = 0.7, axis: Axis = BARS) -> DataFrame:
    """Every full window of ``n`` rows, this one included, kept if enough of its values are finite."""
    h = Halo.spread(df.select(*axis.id, *cols), axis, back=n)
    finite = sum(
        (F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False)).cast("int") for c in cols[1:]),
        F.coalesce(F.abs(F.col(cols[0]).cast("double")) < F.lit(float("inf")), F.lit(False)).cast("int"),
    )
    frame = h.frame.withColumn("_finite", finite).withColumns(
        {"window": _collected(h, cols, n - 1, 0), "_known": F.sum("_finite").over(h.last(n)), "_len": F.count(F.lit(1)).over(h.last(n))}
    )
    kept = (F.col("_len") == n) & (F.col("_known") / F.lit(n * len(cols)) > finite_share)
    rows = h.settle(frame.withColumn("_kept", kept)).filter("_kept")
    return rows.select(*axis.id, (F.col("_known") / F.lit(n * len(cols))).alias("finite_share"), "window")


def pad_sequences(df: DataFrame, n_features: int, where: str = "front", window: str = "window", size: str = "size") -> DataFrame:
    """Equal lengths: ``front`` pads (or cuts) in front to mean + 1.5 deviations of the sizes within the
    limits, ``back`` pads behind to the longest."""
    target = F.floor(F.avg(size) + 1.5 * F.stddev_pop(size)).cast("int")
    target = F.greatest(F.least(target, F.lit(MAX_WINDOW)), F.lit(MIN_WINDOW)) if where == "front" else F.max(size).cast("int")
    # One row with one number.
    one = F.broadcast(df.agg(target.alias("length")))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), n_features), F.greatest(F.col("length") - F.size(window), F.lit(0)))
    if where == "front":
        kept = F.slice(window, F.greatest(F.size(window) - F.col("length") + 1, F.lit(1)), F.greatest(F.col("length"), F.lit(1)))
        padded = F.concat(zeros, kept)
    else:
        padded = F.concat(F.col(window), zeros)
    return df.crossJoin(one).withColumn(window, padded)


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "robust") -> DataFrame:
    """One row with ``centre_<c>`` and ``spread_<c>``: fit on the training rows only."""
    if method == "robust":
        names = {f"{q}_{c}": (c, p) for c in cols for q, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
        # One group: all rows.
        q = quantile_columns(df.select(F.lit(0).alias("_all"), *cols), names, ["_all"])
        pairs = [(c, F.col(f"q2_{c}"), F.col(f"q3_{c}") - F.col(f"q1_{c}")) for c in cols]
        return q.select(*[e for c, m, s in pairs for e in (m.alias(f"centre_{c}"), _not_zero(s).alias(f"spread_{c}"))])
    parts = []
    for c in cols:
        if method == "standard":
            centre, spread = F.avg(c), F.stddev_pop(c)
        elif method == "minmax":
            centre, spread = F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")
        else:
            raise ValueError(f"unknown method {method}")
        parts += [centre.alias(f"centre_{c}"), _not_zero(spread).alias(f"spread_{c}")]
    return df.agg(*parts)


def _not_zero(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def apply_scaler(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaled columns in place; ``fitted`` is one row, so it is sent to every task."""
    scaled = {c: (F.col(c) - F.col(f"centre_{c}")) / F.col(f"spread_{c}") for c in cols}
    return df.crossJoin(F.broadcast(fitted)).withColumns(scaled).select(*df.columns)


def flatten_windows(df: DataFrame, cols: Sequence[str], window: str = "window") -> DataFrame:
    """Windows to one row per time step, for fitting scalers on all steps."""
    rows = df.select(*[c for c in df.columns if c != window], F.posexplode(window).alias("step", "_row"))
    return rows.withColumns({c: F.get("_row", F.lit(i)) for i, c in enumerate(cols)}).drop("_row")


def quantile_normal(df: DataFrame, column: str, name: str) -> DataFrame:
    """Append the normal score of the average rank of ``column`` (ranks from 0 to 1, clipped at 1e-7)."""
    ranks = value_ranks(df.select(column), column)
    share = (F.col("below") + (F.col("c") - 1) / 2) / F.greatest(F.col("n") - 1, F.lit(1))
    clipped = F.least(F.greatest(share, F.lit(1e-7)), F.lit(1 - 1e-7))
    scores = ranks.select(column, normal_quantile(clipped).alias(name))
    return df.join(scores, [column], "left")


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson power of ``x``."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _power_points(df: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """(lam, centre, var, fit) of each point of the grid, from one aggregate; fit is the normal likelihood."""
    x = F.col(column).cast("double")
    one = df.agg(
        F.count(x).alias("_n"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("_logs"),
        *[F.struct(F.lit(v).alias("lam"), F.avg(p).alias("centre"), F.var_pop(p).alias("var")).alias(f"_{i}") for i, (v, p) in enumerate((v, yeo_johnson(x, F.lit(v))) for v in grid)],
    )
    points = one.select("_n", "_logs", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(grid))])))
    likelihood = -F.col("_n") / 2 * F.log("var") + (F.col("lam") - 1) * F.col("_logs")
    return points.select("lam", "centre", "var", likelihood.alias("fit"))


def _best_power(points: DataFrame) -> DataFrame:
    best = points.agg(F.max_by(F.struct("lam", "centre", "var"), "fit").alias("_b"))
    return best.select("_b.lam", "_b.centre", F.sqrt("_b.var").alias("spread"))


def fit_power(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, step: float = 0.1) -> DataFrame:
    """One row (lam, centre, spread): the grid point of greatest normal likelihood, from one aggregate."""
    grid = [round(low + i * step, 10) for i in range(int(round((high - low) / step)) + 1)]
    return _best_power(_power_points(df, column, grid))


def fit_power_closely(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, step: float = 0.1, digits: int = 4, widest: float = 64.0) -> DataFrame:
    """One row (lam, centre, spread): the exponent of greatest likelihood to ``digits`` decimals.

    While the best point of the grid is its first or last one, the grid moves on that way, up to ``widest``; then ten times
    finer ones lie around the best point. Each is one aggregate and one number to the driver. ``df`` is read for each.
    """
    points = int(round((high - low) / step))

    def best(grid: Sequence[float]) -> float | None:
        return _best_power(_power_points(df, column, grid)).first()["lam"]

    found = best([round(low + i * step, 10) for i in range(points + 1)])
    if found is None:  # no value, or all the same
        return fit_power(df, column, 1.0, 1.0, 1.0)
    while found in (round(low, 10), round(high, 10)) and abs(found) < widest:
        low, high = (found - (high - low), found) if found == round(low, 10) else (found, found + (high - low))
        moved = best([round(low + i * step, 10) for i in range(points + 1)])
        if moved is None or moved == found:
            break
        found = moved
    while round(step, 10) > 10**-digits:
        step /= 10
        found = best([round(found + i * step, 10) for i in range(-10, 11)])
    return fit_power(df, column, found, found, 1.0)


def power_transform(df: DataFrame, column: str, name: str, fitted: DataFrame | None = None) -> DataFrame:
    """Append the standardised Yeo-Johnson power of ``column``."""
    one = F.broadcast(fitted if fitted is not None else fit_power(df, column))
    value = (yeo_johnson(F.col(column).cast("double"), F.col("lam")) - F.col("centre")) / _not_zero(F.col("spread"))
    return df.crossJoin(one).withColumn(name, value).drop("lam", "centre", "spread")


def time_split(df: DataFrame, test: float = 0.2, validation: float = 0.1, axis: Axis = BARS) -> DataFrame:
    """Append ``split``: the last share of each series is test, the end of the rest validation."""
    rows = numbered(df, axis, "_rn", size="_rows")
    test_from = F.floor(F.col("_rows") * F.lit(1 - test))
    validation_from = F.floor(test_from * F.lit(1 - validation))
    split = F.when(F.col("_rn") > test_from, "test").when(F.col("_rn") > validation_from, "val").otherwise("train")
    return rows.withColumn("split", split).drop("_rn", "_rows")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    # A class may hold most rows; its one weight goes to many tasks.
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return join_stats(df, weights, [label], "inner")


def imbalance_profile(df: DataFrame, label: str = "label", limit: float = 0.3) -> DataFrame:
    """One row: smallest and largest class, their ratio, and oversample below ``limit``, else weights."""
    sizes = class_counts(df, label).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("classes"))
    ratio = F.col("smallest") / F.col("largest")
    return sizes.withColumns({"ratio": ratio, "strategy": F.when(ratio < limit, "oversample").otherwise("weights")})


def undersample(df: DataFrame, id: str, label: str = "label", cell: float | None = None) -> DataFrame:
    """The first rows by ``id`` of every class, as many as the smallest class has.

    Ids are numbered per class in cells of like row counts, so a large class is not ranked in one task.
    """
    smallest = class_counts(df, label).agg(F.min("n").alias("_smallest"))
    ranked = numbered(df, Axis(keys=(label,), ts=id, cell=cell), "_nth")
    return ranked.crossJoin(F.broadcast(smallest)).filter(F.col("_nth") <= F.col("_smallest")).select(*df.columns)


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends only on the given values, so a lost task gives it again."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def smote(df: DataFrame, cols: Sequence[str], id: str, label: str = "label", k: int = 5, cell: float | None = None) -> DataFrame:
    """Synthetic rows (label, base id, copy, cols) that bring every class to the size of the largest.

    Each lies on the segment from a row to one of its ``k`` nearest rows of the same class. A class of n
    rows that lacks m gives each row m div n copies and one more to the first m mod n rows.
    """
    cols = list(cols)
    rows = stage(df.select(label, id, *[F.col(c).cast("double") for c in cols]), "smote")
    counts = class_counts(rows, label)
    largest = counts.agg(F.max("n").alias("_largest"))
    lacking = counts.crossJoin(F.broadcast(largest)).filter(F.col("n") < F.col("_largest")).select(label, "n", (F.col("_largest") - F.col("n")).alias("_lack"))
    minority = join_stats(rows, lacking, [label], "inner")
    ranked = numbered(minority, Axis(keys=(label,), ts=id, cell=cell), "_nth")
    extra = (F.col("_nth") <= F.col("_lack") % F.col("n")).cast("bigint")
    copies = F.floor(F.col("_lack") / F.col("n")) + extra
    wanted = ranked.filter(copies > 0).select(label, F.col(id).alias(f"q_{id}"), F.explode(F.sequence(F.lit(1).cast("bigint"), copies)).alias("copy"))
    minority_rows = minority.select(label, id, *cols)
    pairs = stage(nearest(minority_rows, minority_rows, cols, k, [label], id), "pairs")
    found = pairs.groupBy(label, f"q_{id}").agg(F.count(F.lit(1)).alias("_found"))
    pick = F.pmod(F.xxhash64(F.col(f"q_{id}"), F.col("copy")), F.col("_found")) + 1
    chosen = wanted.join(found, [label, f"q_{id}"]).withColumn("place", pick.cast("int"))
    gap = _uniform(F.col(f"q_{id}"), F.col("copy"), F.lit("gap"))
    joined = chosen.join(pairs, [label, f"q_{id}", "place"])
    values = [(F.col(f"q_{c}") + (F.col(f"b_{c}") - F.col(f"q_{c}")) * gap).alias(c) for c in cols]
    return joined.select(label, F.col(f"q_{id}").alias(id), "copy", *values)


def knn_impute(df: DataFrame, cols: Sequence[str], id: str, k: int = 5, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Nulls take the mean of their column over the ``k`` nearest complete rows of the series, by distance
    over the columns the row has; a row without any column stays."""
    cols, by = list(cols), list(by)
    rows = stage(df, "impute")
    holes = F.lit(False)
    for c in cols:
        holes = holes | F.col(c).isNull()
    pairs = nearest(rows.filter(holes), rows.filter(~holes), cols, k, by, id)
    means = pairs.groupBy(*by, F.col(f"q_{id}").alias(id)).agg(*[F.avg(f"b_{c}").alias(f"_near_{c}") for c in cols])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_near_{c}")) for c in cols}
    return rows.join(means, [*by, id], "left").withColumns(filled).select(*df.columns)


def walk_forward_folds(df: DataFrame, k: int, axis: Axis = BARS) -> DataFrame:
    """Append ``fold``: 0 for rows never tested, else the fold 1..k whose test block holds the row. The
    training rows of fold f are those with a smaller fold."""
    rows = numbered(df, axis, "_rn", size="_rows")
    size = F.floor(F.col("_rows") / (k + 1))
    first = F.col("_rows") - k * size
    place = F.col("_rn") - 1
    fold = F.when(place < first, 0).otherwise(F.floor((place - first) / size) + 1)
    return rows.withColumn("fold", fold.cast("int")).drop("_rn", "_rows")
