"""Queries on training windows, scaling, splits and class balance."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.clean import dirty
from tidemark.catalog.indicators import bars, frame, simple_state_sql, vol
from tidemark.fixtures import bars30, bars_user, table
from tidemark.operators import indicators as X
from tidemark.operators import sampling as P
from tidemark.operators.keys import PRICES
from tidemark.session import stage

TREND = f"coalesce(CASE WHEN rn >= 14 THEN abs(avg(close) OVER {frame(7)} - avg(close) OVER {frame(14)}) / nullif(avg(close) OVER {frame(14)}, 0) END, 0.5)"
VOL = f"coalesce({vol(20, 5)}, 0)"
SIZE = "least(greatest(floor(60 * (CASE WHEN v > 0.03 THEN 0.7 WHEN v > 0.015 THEN 0.85 WHEN v > 0 THEN 1.2 ELSE 1.0 END)::DOUBLE * (0.8::DOUBLE + 0.4::DOUBLE * trend)), 30), 120)::INT"
LABELED = f"""{bars()}, lab AS (SELECT symbol, ts, rn, close, volume, {simple_state_sql()} AS market_state, {VOL} AS v, {TREND} AS trend,
   count(*) OVER (PARTITION BY symbol) AS n FROM b)"""


def labeled(spark, sf):
    return stage(X.market_state_simple(bars30(spark, sf).select("symbol", "ts", "close", "volume")), "labeled")


@query("dynamic_window_size", f"WITH {LABELED} SELECT symbol, ts, {SIZE} AS size, CASE WHEN v > 0.03 THEN 30 WHEN v > 0.015 THEN 45 ELSE 60 END AS stepped FROM lab", ("bars30",))
def _(spark, sf):
    df = X.trend_strength(X.rolling_volatility(bars30(spark, sf).select("symbol", "ts", "close"), 20, 5))
    v = F.coalesce(F.col("volatility"), F.lit(0.0))
    return df.select(
        "symbol", "ts", P.dynamic_window_size(v, F.col("trend_strength")).alias("size"), P.stepped_window_size(v).alias("stepped")
    )


def window_summary(df):
    """First and last close, volume sum and length of each window."""
    steps = F.transform("window", lambda r: F.get(r, F.lit(1)))
    volume = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    first, last = F.get(F.get("window", F.lit(0)), F.lit(0)), F.get(F.element_at("window", -1), F.lit(0))
    return df.withColumns({"first_close": first, "last_close": last, "volume": volume}).drop("window")


WINDOWS = """SELECT w.symbol, {stamp}, {label} AS label, count(*)::INT AS size, first(b.close ORDER BY b.rn) AS first_close, last(b.close ORDER BY b.rn) AS last_close,
   sum(b.volume)::DOUBLE AS volume FROM sized w JOIN b ON b.symbol = w.symbol AND b.rn BETWEEN w.rn - w.size AND w.rn - 1"""


@query(
    "sequences",
    f"""WITH {LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n AND (rn - 61) % 3 = 0)
        {WINDOWS.format(stamp='w.ts', label='w.market_state')} GROUP BY w.symbol, w.ts, w.market_state HAVING count(*) >= 30""",
    ("bars30",),
)
def _(spark, sf):
    return window_summary(P.sequences(labeled(spark, sf), ["close", "volume"], stride=3))


@query(
    "sequences_next",
    f"""WITH {LABELED}, v30 AS (SELECT symbol, rn, CASE WHEN count(*) OVER (PARTITION BY symbol) > 30 THEN {vol(30, 10)} END AS v30 FROM b),
        sized AS (SELECT lab.*, greatest(30, least(CASE WHEN v30 > 0.03 THEN 30 WHEN v30 > 0.015 THEN 45 ELSE 60 END, rn - 1)) AS size,
                  lead(ts) OVER o AS next_ts, lead(market_state) OVER o AS next_state FROM lab JOIN v30 USING (symbol, rn) WINDOW o AS (PARTITION BY symbol ORDER BY rn)),
        big AS (SELECT * FROM sized WHERE rn - 1 >= 60 AND next_ts IS NOT NULL)
        {WINDOWS.format(stamp='w.next_ts AS ts', label='w.next_state').replace('FROM sized w', 'FROM big w')} GROUP BY w.symbol, w.next_ts, w.next_state""",
    ("bars30",),
)
def _(spark, sf):
    return window_summary(P.sequences_next(labeled(spark, sf), ["close", "volume"]))


@query(
    "sequences_fixed",
    f"""WITH s AS (SELECT symbol, ts, rn, CASE WHEN rn % 3 = 0 OR rn BETWEEN 300 AND 500 THEN NULL ELSE close END AS close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars30)),
        f AS (SELECT symbol, ts, count(*) OVER {frame(60)} AS n, (count(close) OVER {frame(60)} + count(volume) OVER {frame(60)}) / 120 AS share, sum(volume) OVER {frame(60)} AS volume FROM s)
        SELECT symbol, ts, R(share) AS finite_share, volume::DOUBLE AS volume FROM f WHERE n = 60 AND share > 0.7""",
    ("bars30",),
)
def _(spark, sf):
    from tidemark.plans.series import BARS, numbered

    rn = F.col("rn")
    gone = (rn % 3 == 0) | rn.between(300, 500)
    df = numbered(bars30(spark, sf), BARS).withColumn("close", F.when(gone, None).otherwise(F.col("close")))
    windows = P.sequences_fixed(df, ["close", "volume"])
    return rounded(window_summary(windows).drop("first_close", "last_close"), "finite_share")


@query(
    "pad_sequences",
    f"""WITH {LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n), kept AS (SELECT *, least(size, rn - 1) AS len FROM sized),
        target AS (SELECT greatest(least(floor(avg(len) + 1.5 * stddev_pop(len)), 120), 30)::INT AS length, max(len)::INT AS longest FROM kept)
        SELECT w.symbol, w.ts, any_value(w.len)::INT AS size, any_value(length) AS length, any_value(greatest(length - w.len, 0))::INT AS zeros_in_front,
               sum(b.close) FILTER (WHERE b.rn >= w.rn - least(w.len, length)) > 0 AS filled, any_value(longest) AS longest
        FROM kept w JOIN b ON b.symbol = w.symbol AND b.rn BETWEEN w.rn - w.len AND w.rn - 1, target GROUP BY w.symbol, w.ts""",
    ("bars30",),
)
def _(spark, sf):
    windows = stage(P.sequences(labeled(spark, sf), ["close", "volume"]), "windows")
    front = P.pad_sequences(windows, 2)
    step_close = F.transform("window", lambda r: F.get(r, F.lit(0)))
    leading = F.aggregate(
        step_close,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct((a["n"] + (a["open"] & (x == 0)).cast("int")).alias("n"), (a["open"] & (x == 0)).alias("open")),
        lambda a: a["n"],
    )
    behind = P.pad_sequences(windows, 2, "back").select("symbol", "ts", F.size("window").alias("longest"))
    front = front.select(
        "symbol", "ts", "size", F.size("window").alias("length"), leading.alias("zeros_in_front"), F.exists(step_close, lambda x: x > 0).alias("filled")
    )
    return front.join(behind, ["symbol", "ts"])


SPLIT = """sp AS (SELECT *, floor(n * (1 - 0.2)::DOUBLE) AS t, floor(floor(n * (1 - 0.2)::DOUBLE) * (1 - 0.1)::DOUBLE) AS v
   FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars30)),
   split AS (SELECT *, CASE WHEN rn > t THEN 'test' WHEN rn > v THEN 'val' ELSE 'train' END AS split FROM sp)"""


@query("time_split", f"WITH {SPLIT} SELECT symbol, ts, split FROM split", ("bars30",))
def _(spark, sf):
    return P.time_split(bars30(spark, sf).select("symbol", "ts"))


_SCALED = ("open", "close", "volume")
_FITS = {
    "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
}


def _register_scaler(method: str) -> None:
    centre, spread = _FITS[method]
    fits = ", ".join(f"{centre.format(c=c)} AS m_{c}, nullif({spread.format(c=c)}, 0) AS s_{c}" for c in _SCALED)

    @query(
        f"scale_{method}",
        f"WITH {SPLIT}, fit AS (SELECT {fits} FROM split WHERE split = 'train') SELECT symbol, ts, split, "
        + ", ".join(f"R(({c} - m_{c}) / coalesce(s_{c}, 1)) AS {c}" for c in _SCALED)
        + " FROM split, fit",
        ("bars30",),
    )
    def _(spark, sf):
        rows = stage(P.time_split(bars30(spark, sf)).select("symbol", "ts", "split", *_SCALED), "split")
        fitted = P.fit_scaler(rows.filter("split = 'train'"), _SCALED, method)
        return rounded(P.apply_scaler(rows, fitted, _SCALED), *_SCALED)


for _method in _FITS:
    _register_scaler(_method)


@query(
    "scale_windows",
    f"""WITH {LABELED}, sized AS (SELECT *, {SIZE} AS size FROM lab WHERE rn - 1 >= 60 AND rn < n AND (rn - 61) % 10 = 0),
        flat AS (SELECT w.symbol, w.ts, b.rn - (w.rn - least(w.size, w.rn - 1)) AS step, b.close, b.volume::DOUBLE AS volume
                 FROM sized w JOIN b ON b.symbol = w.symbol AND b.rn BETWEEN w.rn - w.size AND w.rn - 1),
        fit AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM flat)
        SELECT symbol, ts, step::INT AS step, R((close - mc) / sc) AS close, R((volume - mv) / sv) AS volume FROM flat, fit""",
    ("bars30",),
)
def _(spark, sf):
    return scaled_windows(spark, sf, 10)


def scaled_windows(spark, sf, stride):
    windows = stage(P.sequences(labeled(spark, sf), ["close", "volume"], stride=stride), "windows")
    flat = P.flatten_windows(windows, ["close", "volume"]).drop("label", "size")
    scaled = P.apply_scaler(flat, P.fit_scaler(flat, ["close", "volume"], "standard"), ["close", "volume"])
    return rounded(scaled, "close", "volume")


@query(
    "scale_all_windows",
    f"""WITH {LABELED}, sized AS MATERIALIZED (SELECT symbol, ts, rn, least({SIZE}, rn - 1)::INT AS size FROM lab WHERE rn - 1 >= 60 AND rn < n),
        ends AS (SELECT symbol, rn - size AS rn, 1 AS opened FROM sized UNION ALL SELECT symbol, rn, -1 FROM sized UNION ALL SELECT symbol, rn, 0 FROM b),
        held AS (SELECT symbol, rn, sum(sum(opened)) OVER (PARTITION BY symbol ORDER BY rn) AS h FROM ends GROUP BY symbol, rn),
        seen AS MATERIALIZED (SELECT symbol, rn, close, volume::DOUBLE AS volume, h FROM b JOIN held USING (symbol, rn)),
        mid AS (SELECT sum(h * close) / sum(h) AS mc, sum(h * volume) / sum(h) AS mv FROM seen),
        fit AS MATERIALIZED (SELECT any_value(mc) AS mc, sqrt(sum(h * pow(close - mc, 2)) / sum(h)) AS sc, any_value(mv) AS mv, sqrt(sum(h * pow(volume - mv, 2)) / sum(h)) AS sv FROM seen, mid),
        steps AS (SELECT symbol, ts, rn - size AS start, unnest(range(size))::INT AS step FROM sized)
        SELECT symbol, ts, step, R((close - mc) / sc) AS close, R((volume - mv) / sv) AS volume
        FROM (SELECT s.symbol, s.ts, s.step, close, volume FROM steps s JOIN seen ON seen.symbol = s.symbol AND seen.rn = s.start + s.step), fit""",
    ("bars30",),
)
def _(spark, sf):
    """Every row's window, all of them in the fit."""
    return scaled_windows(spark, sf, 1)


def probit(p: str) -> str:
    """Acklam's approximation as SQL over a column."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def poly(k, x):
        text = f"{k[0]!r}::DOUBLE"
        for v in k[1:]:
            text = f"({text} * {x} + {v!r}::DOUBLE)"
        return text

    def tail(q):
        t = f"sqrt(-2 * ln({q}))"
        return f"{poly(c, t)} / ({poly(d, t)} * {t} + 1)"

    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -({tail(f'(1 - {p})')}) ELSE {poly(a, r)} * ({p} - 0.5) / ({poly(b, r)} * {r} + 1) END"


@query(
    "scale_quantile_normal",
    f"""WITH n AS (SELECT count(*) AS n FROM bars30),
        v AS (SELECT volume, count(*) AS c, sum(count(*)) OVER (ORDER BY volume) - count(*) AS below FROM bars30 GROUP BY 1),
        p AS (SELECT volume, least(greatest((below + (c - 1) / 2) / (n - 1), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p FROM v, n)
        SELECT symbol, ts, R(z) AS score FROM bars30 JOIN (SELECT volume, {probit('p')} AS z FROM p) USING (volume)""",
    ("bars30",),
)
def _(spark, sf):
    df = P.quantile_normal(stage(bars30(spark, sf).select("symbol", "ts", "volume"), "bars"), "volume", "score")
    return rounded(df.drop("volume"), "score")


def yj(x: str, lam: str) -> str:
    up = f"CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END"
    down = f"CASE WHEN abs({lam} - 2) < 1e-9 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END"
    return f"(CASE WHEN {x} >= 0 THEN {up} ELSE {down} END)"


@query(
    "scale_power",
    f"""WITH r AS (SELECT symbol, ts, (close - open)::DOUBLE AS x FROM bars30), grid AS (SELECT round(-2 + i * 0.1, 10)::DOUBLE AS lam FROM range(61) t(i)),
        s AS (SELECT count(*) AS n, sum(sign(x) * ln(1 + abs(x))) AS logs FROM r),
        f AS (SELECT lam, avg({yj('x', 'lam')}) AS centre, var_pop({yj('x', 'lam')}) AS var FROM r, grid GROUP BY lam),
        best AS (SELECT arg_max(lam, fit) AS lam, arg_max(centre, fit) AS centre, arg_max(sqrt(var), fit) AS spread
                 FROM (SELECT *, -n / 2 * ln(var) + (lam - 1) * logs AS fit FROM f, s))
        SELECT symbol, ts, R(({yj('x', 'lam')} - centre) / spread) AS score FROM r, best""",
    ("bars30",),
)
def _(spark, sf):
    df = bars30(spark, sf).select("symbol", "ts", (F.col("close") - F.col("open")).alias("x"))
    return rounded(P.power_transform(df, "x", "score").drop("x"), "score")


def _finer(number: int, step: float) -> str:
    """SQL table ``b<number>``: the best of 21 exponents around the one before."""
    return f"""b{number} AS MATERIALIZED (SELECT arg_max(lam, fit) AS lam, arg_max(centre, fit) AS centre, arg_max(sqrt(var), fit) AS spread FROM (
      SELECT *, -n / 2 * ln(var) + (lam - 1) * logs AS fit FROM s, (SELECT lam, avg({yj('x', 'lam')}) AS centre, var_pop({yj('x', 'lam')}) AS var FROM r,
        (SELECT round(lam + (i - 10) * {step}, 10)::DOUBLE AS lam FROM b{number - 1}, range(21) t(i)) GROUP BY lam)))"""


@query(
    "scale_power_closely",
    f"""WITH r AS (SELECT symbol, ts, (close - open)::DOUBLE AS x FROM bars30), s AS (SELECT count(*) AS n, sum(sign(x) * ln(1 + abs(x))) AS logs FROM r),
        f AS (SELECT lam, avg({yj('x', 'lam')}) AS centre, var_pop({yj('x', 'lam')}) AS var FROM r, (SELECT round(-2 + i * 0.1, 10)::DOUBLE AS lam FROM range(61) t(i)) GROUP BY lam),
        b0 AS MATERIALIZED (SELECT arg_max(lam, -n / 2 * ln(var) + (lam - 1) * logs) AS lam FROM f, s), {_finer(1, 0.01)}, {_finer(2, 0.001)}, {_finer(3, 0.0001)}
        SELECT symbol, ts, R4(lam) AS lam, R(({yj('x', 'lam')} - centre) / spread) AS score FROM r, b3""",
    ("bars30",),
)
def _(spark, sf):
    df = stage(bars30(spark, sf).select("symbol", "ts", (F.col("close") - F.col("open")).alias("x")), "changes")
    fitted = P.fit_power_closely(df, "x")
    scored = P.power_transform(df, "x", "score", fitted).drop("x")
    return rounded(rounded(scored.crossJoin(F.broadcast(fitted.select("lam"))), "score"), "lam", digits=4)


@query(
    "class_weights",
    f"WITH {LABELED}, c AS (SELECT market_state, count(*) AS n FROM lab GROUP BY 1) SELECT market_state, n, R(sum(n) OVER () / (count(*) OVER () * n)) AS weight FROM c",
    ("bars30",),
)
def _(spark, sf):
    df = X.market_state_simple(bars30(spark, sf).select("symbol", "ts", "close"))
    return rounded(P.class_weights(df, "market_state"), "weight")


@query(
    "imbalance_profile",
    f"""WITH {LABELED}, c AS (SELECT market_state, count(*) AS n FROM lab GROUP BY 1)
        SELECT min(n) AS smallest, max(n) AS largest, count(*) AS classes, R(min(n) / max(n)) AS ratio, CASE WHEN min(n) / max(n) < 0.3 THEN 'oversample' ELSE 'weights' END AS strategy FROM c""",
    ("bars30",),
)
def _(spark, sf):
    df = X.market_state_simple(bars30(spark, sf).select("symbol", "ts", "close"))
    return rounded(P.imbalance_profile(df, "market_state"), "ratio")


@query(
    "undersample",
    """SELECT l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY id) AS nth
         FROM (SELECT l_linenumber, l_orderkey, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS id FROM lineitem))
       WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber))""",
)
def _(spark, sf):
    id = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    items = table(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", id.alias("id"))
    return P.undersample(items, "id", "l_linenumber").drop("id")


@query("smote")
def _(spark, sf):
    """Synthetic bars that bring every regime to the size of the largest."""
    df = labeled(spark, sf).withColumn("id", F.concat_ws("|", "symbol", "ts"))
    ids = df.select("market_state", F.xxhash64("id").alias("id"), "close", F.col("volume").cast("double").alias("volume"))
    return P.smote(ids, ["close", "volume"], "id", "market_state")


@query(
    "smote_sizes",
    f"""WITH {LABELED}, c AS (SELECT market_state, count(*) AS n FROM lab GROUP BY 1), m AS (SELECT max(n) AS most FROM c)
        SELECT market_state, n, most - n AS made, TRUE AS on_segment FROM c, m WHERE n < most""",
    ("bars30",),
)
def _(spark, sf):
    """How many rows are made of each regime, and whether each stays within the range of its class."""
    df = stage(labeled(spark, sf).withColumn("id", F.xxhash64(F.concat_ws("|", "symbol", "ts"))), "labeled")
    ids = df.select("market_state", "id", "close", F.col("volume").cast("double").alias("volume"))
    made = P.smote(ids, ["close", "volume"], "id", "market_state")
    spans = ids.groupBy("market_state").agg(F.count("*").alias("n"), F.min("close").alias("lo"), F.max("close").alias("hi"), F.min("volume").alias("vlo"), F.max("volume").alias("vhi"))
    held = made.join(spans, "market_state").groupBy("market_state", "n")
    within = F.col("close").between(F.col("lo"), F.col("hi")) & F.col("volume").between(F.col("vlo"), F.col("vhi"))
    return held.agg(F.count("*").alias("made"), F.bool_and(within).alias("on_segment"))


@query(
    "knn_impute",
    """WITH n AS (SELECT symbol, rn AS id, open, high, low, close FROM dirty),
       q AS (SELECT * FROM n WHERE high IS NULL OR close IS NULL), d AS (SELECT * FROM n WHERE high IS NOT NULL AND close IS NOT NULL),
       p AS (SELECT q.symbol, q.id, d.high, d.close, row_number() OVER (PARTITION BY q.symbol, q.id ORDER BY
               sqrt((coalesce((q.open - d.open) ** 2, 0) + coalesce((q.high - d.high) ** 2, 0) + coalesce((q.low - d.low) ** 2, 0) + coalesce((q.close - d.close) ** 2, 0))
                    * 4 / (2 + (q.high IS NOT NULL)::INT + (q.close IS NOT NULL)::INT)), d.id) AS place FROM q JOIN d ON q.symbol = d.symbol),
       m AS (SELECT symbol, id, avg(high) AS mh, avg(close) AS mc FROM p WHERE place <= 5 GROUP BY 1, 2)
       SELECT symbol, id, open, R(coalesce(high, mh)) AS high, low, R(coalesce(close, mc)) AS close FROM n LEFT JOIN m USING (symbol, id)""",
    ("dirty",),
)
def _(spark, sf):
    df = dirty(spark, sf).select("symbol", F.col("rn").alias("id"), *PRICES)
    return rounded(P.knn_impute(df, PRICES, "id"), "high", "close")


@query(
    "walk_forward_folds",
    """WITH r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars_user)
       SELECT symbol, ts, CASE WHEN i < n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4))) // (n // 4) + 1 END::INT AS fold FROM r""",
    ("bars_user",),
)
def _(spark, sf):
    return P.walk_forward_folds(bars_user(spark, sf).select("symbol", "ts"), 3)

