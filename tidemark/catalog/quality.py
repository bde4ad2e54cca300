"""Queries on data quality."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.clean import AROUND, cleaning_sql, line, out
from tidemark.fixtures import bars30, dirty_bars
from tidemark.operators import clean as C
from tidemark.operators import quality as Q
from tidemark.operators.process import process
from tidemark.operators.keys import OHLCV, PRICES
from tidemark.plans.series import BARS
from tidemark.session import stage

DUP = BARS.with_(ties=("dup",))


def faulty(spark, sf):
    return stage(dirty_bars(spark, sf), "dirty")


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def missing_issues(source: str) -> str:
    return union(
        f"SELECT symbol, 'missing_values' AS issue_type, CASE WHEN m > 0.1 THEN 'critical' ELSE 'warning' END AS severity, '{c}' AS column, m AS value "
        f"FROM (SELECT symbol, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS m FROM {source} GROUP BY 1) WHERE m > 0 UNION ALL "
        f"SELECT symbol, 'zero_values', 'warning', '{c}', m FROM (SELECT symbol, count(*) FILTER (WHERE {c} = 0) / count(*) AS m FROM {source} GROUP BY 1) WHERE m > 0.05"
        for c in OHLCV
    )


@query("check_missing", f"SELECT symbol, issue_type, severity, \"column\", R(value) AS value FROM ({missing_issues('dirty_bars')})", ("dirty_bars",))
def _(spark, sf):
    return rounded(Q.check_missing(dirty_bars(spark, sf), axis=DUP), "value")


@query(
    "repair_missing",
    f"""WITH thin AS (SELECT * REPLACE (CASE WHEN symbol = 'click' AND rn % 3 = 0 THEN NULL ELSE close END AS close,
                                   CASE WHEN symbol = 'view' AND rn % 4 = 0 THEN NULL ELSE volume END AS volume) FROM dirty),
        s AS (SELECT symbol, {', '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS n_{c}' for c in OHLCV)} FROM thin GROUP BY 1),
        f AS (SELECT symbol, ts, {', '.join(f'{line(c)} AS l_{c}, last({c} IGNORE NULLS) OVER prv AS f_{c}' for c in PRICES)}, {', '.join(OHLCV)} FROM thin {AROUND}),
        g AS (SELECT symbol, ts, {', '.join(f'coalesce({c}, CASE WHEN n_{c} > 0.1 THEN l_{c} ELSE f_{c} END) AS {c}' for c in PRICES)},
                     coalesce(volume, CASE WHEN n_volume <= 0.1 THEN 0 END) AS volume FROM f JOIN s USING (symbol))
        SELECT symbol, ts, {', '.join(f'R({c}) AS {c}' for c in OHLCV)} FROM g
        WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL""",
    ("dirty",),
)
def _(spark, sf):
    rn = F.col("rn")
    thin = dirty_bars(spark, sf).filter("dup = 0").withColumns(
        {
            "close": F.when((F.col("symbol") == "click") & (rn % 3 == 0), None).otherwise(F.col("close")),
            "volume": F.when((F.col("symbol") == "view") & (rn % 4 == 0), None).otherwise(F.col("volume")),
        }
    )
    return rounded(Q.repair_missing(stage(thin.select("symbol", "ts", *OHLCV), "dirty")), *OHLCV)


def outlier_ctes(source: str) -> str:
    q = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}, "
        f"median({c}) AS med_{c}, avg({c}) AS avg_{c}, stddev_samp({c}) AS std_{c}"
        for c in OHLCV
    )
    parts = union(
        f"SELECT symbol, '{c}' AS column, count(*) FILTER (WHERE {far(c)}) AS n_outliers, count(*) FILTER (WHERE {far(c)}) / count(*) AS ratio, "
        f"any_value(lo_{c}) AS lower, any_value(hi_{c}) AS upper, count(*) FILTER (WHERE {c} < 0) AS n_negative FROM {source} JOIN lim USING (symbol) GROUP BY 1"
        for c in OHLCV
    )
    return f"lim AS (SELECT symbol, {q} FROM {source} GROUP BY 1), o_stats AS ({parts})"


def far(c: str) -> str:
    return f"({out(c)} OR abs({c} - avg_{c}) / std_{c} > 3)"


def outlier_issues() -> str:
    return """SELECT symbol, 'outliers' AS issue_type, CASE WHEN ratio > 0.1 THEN 'critical' ELSE 'warning' END AS severity, "column", ratio AS value FROM o_stats WHERE ratio > 0.05
      UNION ALL SELECT symbol, 'volume_anomaly', 'critical', 'volume', n_negative FROM o_stats WHERE "column" = 'volume' AND n_negative > 0"""


@query(
    "outlier_stats",
    f'WITH {outlier_ctes("dirty_bars")} SELECT symbol, "column", n_outliers, R(ratio) AS ratio, R(lower) AS lower, R(upper) AS upper, n_negative FROM o_stats',
    ("dirty_bars",),
)
def _(spark, sf):
    return rounded(Q.outlier_stats(faulty(spark, sf), axis=DUP), "ratio", "lower", "upper")


@query(
    "check_outliers",
    f'WITH {outlier_ctes("dirty_bars")} SELECT symbol, issue_type, severity, "column", R(value) AS value FROM ({outlier_issues()})',
    ("dirty_bars",),
)
def _(spark, sf):
    return rounded(Q.check_outliers(faulty(spark, sf), axis=DUP), "value")


@query(
    "repair_outliers",
    f"WITH {outlier_ctes('dirty')} SELECT symbol, ts, "
    + ", ".join(f"R(CASE WHEN {far(c)} THEN med_{c} ELSE {c} END) AS {c}" for c in PRICES)
    + ", CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume FROM dirty JOIN lim USING (symbol)",
    ("dirty",),
)
def _(spark, sf):
    df = stage(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", *OHLCV), "dirty")
    return rounded(Q.repair_outliers(df), *PRICES)


def step_ctes(source: str, order: str) -> str:
    return f"""stp AS (SELECT symbol, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY {order}))) / 1e6 AS step FROM {source}),
      stp_n AS (SELECT symbol, step, count(*) AS n FROM stp WHERE step IS NOT NULL GROUP BY 1, 2),
      stp_mode AS (SELECT symbol, arg_max(step, (n, -step)) AS modal FROM stp_n GROUP BY 1),
      s_stats AS (SELECT symbol, sum(n) AS n_steps, any_value(modal) AS modal, sum(n) FILTER (WHERE step = modal) / sum(n) AS consistency,
                  coalesce(sum(n) FILTER (WHERE step > 2 * modal), 0) AS n_gaps, coalesce(sum(n) FILTER (WHERE step = 0), 0) AS n_doubled
                  FROM stp_n JOIN stp_mode USING (symbol) GROUP BY 1)"""


CONTINUITY = """SELECT symbol, 'time_continuity' AS issue_type, CASE WHEN n_gaps / (n_steps + 1) > 0.05 THEN 'critical' ELSE 'warning' END AS severity,
     'index' AS column, n_gaps::DOUBLE AS value FROM s_stats WHERE n_gaps > 0
   UNION ALL SELECT symbol, 'duplicate_timestamps', 'warning', 'index', n_doubled FROM s_stats WHERE n_doubled > 0"""
FREQUENCY = """SELECT symbol, 'frequency_consistency' AS issue_type, 'warning' AS severity, 'index' AS column, consistency AS value
   FROM s_stats WHERE consistency < 0.9"""


@query("check_continuity", f"WITH {step_ctes('dirty_bars', 'ts, dup')} {CONTINUITY}", ("dirty_bars",))
def _(spark, sf):
    return Q.check_continuity(faulty(spark, sf), DUP)


@query(
    "check_frequency",
    f'WITH {step_ctes("dirty_bars", "ts, dup")} SELECT symbol, issue_type, severity, "column", R(value) AS value FROM ({FREQUENCY})',
    ("dirty_bars",),
)
def _(spark, sf):
    return rounded(Q.check_frequency(faulty(spark, sf), DUP), "value")


def range_issues(source: str) -> str:
    high = "NOT (high >= open AND high >= close AND high >= low)"
    low = "NOT (low <= open AND low <= close AND low <= high)"
    checks = [("high", high), ("low", low)]
    before = "TRUE"
    for c in PRICES:
        checks.append((c, f"{before} AND {c} <= 0"))
        before += f" AND {c} > 0"
    return union(
        f"SELECT symbol, 'price_anomaly' AS issue_type, 'critical' AS severity, '{c}' AS column, count(*)::DOUBLE AS value FROM {source} WHERE {test} GROUP BY 1"
        for c, test in checks
    )


@query("check_ranges", range_issues("dirty_bars"), ("dirty_bars",))
def _(spark, sf):
    return Q.check_ranges(dirty_bars(spark, sf), DUP)


@query(
    "describe_columns",
    union(
        f"SELECT symbol, '{c}' AS column, count({c}) AS count, R(avg({c})) AS mean, R(stddev_samp({c})) AS std, R(min({c})) AS min, R(max({c})) AS max, "
        f"R(quantile_cont({c}, 0.25)) AS q25, R(quantile_cont({c}, 0.5)) AS q50, R(quantile_cont({c}, 0.75)) AS q75 FROM dirty GROUP BY 1"
        for c in OHLCV
    ),
    ("dirty",),
)
def _(spark, sf):
    df = stage(dirty_bars(spark, sf).filter("dup = 0"), "dirty")
    return rounded(Q.describe_columns(df), "mean", "std", "min", "max", "q25", "q50", "q75")


@query(
    "series_stats",
    """WITH r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars30)
       SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, R(avg(ret)) AS mean_return, R(stddev_samp(ret)) AS volatility,
              R(max(ret)) AS max_return, R(min(ret)) AS min_return, R(skewness(ret)) AS skewness, R(kurtosis(ret)) AS kurtosis FROM r GROUP BY 1""",
    ("bars30",),
)
def _(spark, sf):
    return rounded(Q.series_stats(bars30(spark, sf)), "mean_return", "volatility", "max_return", "min_return", "skewness", "kurtosis")


def report_ctes(source: str, order: str, prefix: str = "") -> str:
    """CTE ``<prefix>report``: status and issue counts per symbol."""
    names = ("lim", "o_stats", "stp", "stp_n", "stp_mode", "s_stats", "issues", "report")
    types = ", ".join(f"count(*) FILTER (WHERE issue_type = '{t}') AS n_{t}" for t in Q.ISSUE_TYPES)
    text = f"""{outlier_ctes(source)}, {step_ctes(source, order)},
      issues AS ({missing_issues(source)} UNION ALL {outlier_issues()} UNION ALL {CONTINUITY} UNION ALL {FREQUENCY} UNION ALL {range_issues(source)}),
      report AS (SELECT symbol, any_value(rows) AS rows,
                 CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical' WHEN count(issue_type) > 0 THEN 'warning' ELSE 'healthy' END AS status,
                 count(issue_type) AS total_issues, count(*) FILTER (WHERE severity = 'critical') AS critical_issues,
                 count(*) FILTER (WHERE severity = 'warning') AS warning_issues, {types}
                 FROM (SELECT symbol, count(*) AS rows FROM {source} GROUP BY 1) LEFT JOIN issues USING (symbol) GROUP BY 1)"""
    if prefix:
        import re

        for name in names:
            text = re.sub(rf"(?<![\w.]){name}(?!\w)", prefix + name, text)
    return text


@query("health_issues", f"WITH {report_ctes('dirty_bars', 'ts, dup')} SELECT symbol, issue_type, severity, \"column\", R(value) AS value FROM issues", ("dirty_bars",))
def _(spark, sf):
    return rounded(Q.all_issues(faulty(spark, sf), DUP), "value")


@query("health_report", f"WITH {report_ctes('dirty_bars', 'ts, dup')} SELECT * FROM report", ("dirty_bars",))
def _(spark, sf):
    return Q.health_report(faulty(spark, sf), DUP)


def repaired_ctes() -> str:
    cols = ", ".join(OHLCV)
    fill = ", ".join(f"coalesce({c}, CASE WHEN n_{c} > 0.1 THEN l_{c} ELSE f_{c} END) AS {c}" for c in PRICES)
    return f"""numbered AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY symbol ORDER BY ts, dup) AS rn FROM dirty_bars),
      shares AS (SELECT symbol, {', '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS n_{c}' for c in OHLCV)} FROM numbered GROUP BY 1),
      lines AS (SELECT symbol, ts, dup, {', '.join(f'{line(c)} AS l_{c}, last({c} IGNORE NULLS) OVER prv AS f_{c}' for c in PRICES)}, {cols} FROM numbered {AROUND}),
      filled AS (SELECT symbol, ts, dup, {fill}, coalesce(volume, CASE WHEN n_volume <= 0.1 THEN 0 END) AS volume FROM lines JOIN shares USING (symbol)),
      whole AS (SELECT * FROM filled WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL),
      {outlier_ctes('whole').replace('lim AS', 'wlim AS').replace('JOIN lim', 'JOIN wlim').replace('o_stats', 'w_stats')},
      calm AS (SELECT symbol, ts, dup, {', '.join(f'CASE WHEN {far(c)} THEN med_{c} ELSE {c} END AS {c}' for c in PRICES)}, greatest(volume, 0) AS volume
               FROM whole JOIN wlim USING (symbol)),
      repaired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY dup) AS nth FROM calm)
                   WHERE nth = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0)"""


@query(
    "health_repair",
    f"WITH {repaired_ctes()} SELECT symbol, ts, {', '.join(f'R({c}) AS {c}' for c in OHLCV)} FROM repaired",
    ("dirty_bars",),
)
def _(spark, sf):
    return rounded(Q.repair(faulty(spark, sf).drop("rn"), DUP).drop("dup"), *OHLCV)


@query(
    "health_report_repaired",
    f"""WITH {report_ctes('dirty_bars', 'ts, dup')}, {repaired_ctes()}
        SELECT symbol, rows, status, total_issues, rows - kept AS rows_removed, R((rows - kept) / rows * 100) AS removed_pct
        FROM report JOIN (SELECT symbol, count(*) AS kept FROM repaired GROUP BY 1) USING (symbol)""",
    ("dirty_bars",),
)
def _(spark, sf):
    df = faulty(spark, sf).drop("rn")
    report = Q.health_report(df, DUP, Q.repair(df, DUP))
    return rounded(report.select("symbol", "rows", "status", "total_issues", "rows_removed", "removed_pct"), "removed_pct")


@query(
    "legacy_health",
    f"""WITH m AS (SELECT symbol, {', '.join(f'avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}' for c in OHLCV)} FROM dirty GROUP BY 1),
        r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        s AS (SELECT symbol, greatest({', '.join(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)' for c in OHLCV)}) AS missing_ratio,
              greatest({', '.join(f'count(*) FILTER (WHERE {c} = 0) / count(*)' for c in OHLCV)}) AS zero_ratio,
              greatest({', '.join(f'count(*) FILTER (WHERE abs({c} - a_{c}) > 5 * s_{c}) / count(*)' for c in OHLCV)}) AS outlier_ratio,
              count(*) FILTER (WHERE volume < 0) > 0 AS negative_volume, max(us) > 129600000000 AS discontinuous,
              stddev_samp(ret) AS volatility, skewness(volume) AS volume_skew FROM r JOIN m USING (symbol) GROUP BY 1)
        SELECT symbol, R(missing_ratio) AS missing_ratio, R(zero_ratio) AS zero_ratio, R(outlier_ratio) AS outlier_ratio, negative_volume, discontinuous,
               R(volatility) AS volatility, R(volume_skew) AS volume_skew,
               (missing_ratio > 0.1)::INT + (zero_ratio > 0.05)::INT + negative_volume::INT + discontinuous::INT AS n_issues, missing_ratio = 0 AS is_clean FROM s""",
    ("dirty",),
)
def _(spark, sf):
    df = stage(dirty_bars(spark, sf).filter("dup = 0"), "dirty")
    return rounded(Q.legacy_health(df), "missing_ratio", "zero_ratio", "outlier_ratio", "volatility", "volume_skew")


@query(
    "quality_profile",
    f"""WITH q AS (SELECT symbol, quantile_cont(close, [0.25, 0.75]) AS q FROM dirty GROUP BY 1),
        b AS (SELECT symbol, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM q),
        g AS (SELECT symbol, count(*) AS points FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM dirty GROUP BY 1) GROUP BY 1),
        s AS (SELECT symbol, count(*) AS n, {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in OHLCV)} AS m, avg(close) AS a, stddev_samp(close) AS sd,
                     min(close) AS mi, max(close) AS ma, count(*) FILTER (WHERE close < lo OR close > hi) AS o, any_value(lo) AS lo, any_value(hi) AS hi
              FROM dirty JOIN b USING (symbol) GROUP BY 1)
        SELECT symbol, n AS total_records, m AS missing_count, R(m / (n * 5) * 100) AS missing_pct, R(a) AS close_mean, R(sd) AS close_std, R(mi) AS close_min,
               R(ma) AS close_max, o AS outlier_count, R(o / n * 100) AS outlier_pct, R(lo) AS outlier_lower, R(hi) AS outlier_upper,
               points - n AS grid_missing, R((points - n) / points * 100) AS grid_missing_pct FROM s JOIN g USING (symbol)""",
    ("dirty",),
)
def _(spark, sf):
    df = stage(dirty_bars(spark, sf).filter("dup = 0"), "dirty")
    profile = Q.quality_profile(df, 1800)
    return rounded(profile, *[c for c, t in profile.dtypes if t == "double"])


@query(
    "stage_report",
    union(
        f"SELECT symbol, 'raw' AS stage, count(*) AS sample_count, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
        f"count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} IS NULL) AS n_not_finite FROM dirty GROUP BY 1"
        for c in OHLCV
    ),
    ("dirty",),
)
def _(spark, sf):
    return Q.stage_report(dirty_bars(spark, sf).filter("dup = 0"), "raw")


# Two series are taken as daily bars without faults, so that the gate has series to pass.
MIXED = f"""mixed AS (SELECT symbol, ts, open, high, low, close, volume FROM dirty_bars WHERE dup = 0 AND symbol NOT IN ('click', 'view')
  UNION ALL SELECT symbol, date_trunc('day', ts)::TIMESTAMP, first(open ORDER BY ts), max(high), min(low), last(close ORDER BY ts), sum(volume)::BIGINT
  FROM bars30 WHERE symbol IN ('click', 'view') GROUP BY 1, 2)"""


def mixed(spark, sf):
    bad = dirty_bars(spark, sf).filter("dup = 0 and symbol not in ('click', 'view')").select("symbol", "ts", *OHLCV)
    good = bars30(spark, sf, 86400).filter("symbol in ('click', 'view')").select("symbol", "ts", *OHLCV)
    return stage(bad.unionByName(good), "mixed")


@query(
    "quality_gate",
    f"WITH {MIXED}, {report_ctes('mixed', 'ts')} SELECT symbol, ts, close FROM mixed WHERE symbol IN (SELECT symbol FROM report WHERE status IN ('healthy', 'warning'))",
    ("dirty_bars",),
)
def _(spark, sf):
    df = mixed(spark, sf)
    return Q.quality_gate(df, Q.health_report(df)).select("symbol", "ts", "close")


def flow_ctes() -> str:
    return f"""{report_ctes('dirty', 'ts', 'raw_')}, {cleaning_sql('standard')}, {report_ctes('cleaned', 'ts', 'new_')},
      flow AS (SELECT symbol, a.rows AS original_rows, a.status AS original_status, a.total_issues AS original_issues, b.rows AS cleaned_rows,
                      b.status AS final_status, b.total_issues AS final_issues, first_ts, last_ts, a.rows - b.rows AS rows_removed,
                      (a.rows - b.rows) / a.rows * 100 AS removed_pct, a.total_issues > b.total_issues AS improved
               FROM raw_report a JOIN new_report b USING (symbol)
               JOIN (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM cleaned GROUP BY 1) USING (symbol))"""


def flow(spark, sf):
    raw = stage(dirty_bars(spark, sf).filter("dup = 0").select("symbol", "ts", *OHLCV), "dirty")
    return Q.flow_report(raw, stage(C.clean(raw), "cleaned"))


@query("flow_report", f"WITH {flow_ctes()} SELECT * REPLACE (R(removed_pct) AS removed_pct) FROM flow", ("dirty",))
def _(spark, sf):
    return rounded(flow(spark, sf), "removed_pct")


@query(
    "batch_summary",
    f"""WITH {flow_ctes()} SELECT count(*) AS symbols, count(*) FILTER (WHERE final_status IN ('healthy', 'warning')) AS passing,
        count(*) FILTER (WHERE final_status NOT IN ('healthy', 'warning')) AS failing,
        R(count(*) FILTER (WHERE final_status IN ('healthy', 'warning')) / count(*) * 100) AS success_pct, sum(original_rows)::BIGINT AS rows_in,
        sum(cleaned_rows)::BIGINT AS rows_out, R(sum(cleaned_rows) / sum(original_rows) * 100) AS retention_pct, count(*) FILTER (WHERE improved) AS improved FROM flow""",
    ("dirty",),
)
def _(spark, sf):
    return rounded(Q.batch_summary(flow(spark, sf)), "success_pct", "retention_pct")


def processed(spark, sf, threshold="warning"):
    return process(dirty_bars(spark, sf).filter("dup = 0"), threshold=threshold)


@query(
    "process_flow",
    f"""WITH {flow_ctes()} SELECT * REPLACE (R(removed_pct) AS removed_pct), final_status IN ('healthy', 'warning') AS passed FROM flow""",
    ("dirty",),
)
def _(spark, sf):
    """Check, clean, check and gate of all series in one call."""
    out = processed(spark, sf)
    kept = out.passed.select("symbol").distinct().withColumn("passed", F.lit(True))
    return rounded(out.flow.join(kept, "symbol", "left").withColumn("passed", F.coalesce("passed", F.lit(False))), "removed_pct")


@query(
    "process_rows",
    f"""WITH {flow_ctes()} SELECT symbol, ts, R(open) AS open, R(close) AS close, R(volume) AS volume FROM cleaned JOIN flow USING (symbol) WHERE final_status IN ('healthy', 'warning', 'critical')""",
    ("dirty",),
)
def _(spark, sf):
    return rounded(processed(spark, sf, "critical").passed.select("symbol", "ts", "open", "close", "volume"), "open", "close", "volume")
