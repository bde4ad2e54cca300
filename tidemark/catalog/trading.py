"""Queries on signals, costs, ledgers and performance."""

from pyspark.sql import functions as F

from tidemark.catalog.base import query, rounded
from tidemark.catalog.indicators import FEATURES, frame, vol
from tidemark.fixtures import EQUITY, FILLS, bars30, bars_user, equity, ledger
from tidemark.operators import indicators as X
from tidemark.operators import ledger as L
from tidemark.operators import performance as R
from tidemark.operators import signals as S
from tidemark.operators.clean import strip_zero_bars
from tidemark.session import stage

# ---------------------------------------------------------------------------------------------------------
# Signals. Ranges and volatility are taken at a tenth: the fixture's prices jump far more than a market's.

SIGNALS = f"""{FEATURES}, sg0 AS (SELECT f.symbol, f.ts, f.rn, f.close, f.atr * 0.1 AS atr, f.rsi, f.volume, f.market_state, s.simple AS prediction, coalesce(v.volatility, 0) * 0.1 AS volatility
      FROM features f JOIN (SELECT symbol, rn, CASE WHEN avg(close) OVER {frame(5)} > avg(close) OVER {frame(20)} * 1.002 THEN 2
             WHEN avg(close) OVER {frame(5)} < avg(close) OVER {frame(20)} * 0.998 THEN 0 ELSE 1 END AS simple FROM b) s USING (symbol, rn)
      JOIN (SELECT symbol, rn, {vol(20, 5)} AS volatility FROM b) v USING (symbol, rn)),
   sm AS (SELECT symbol, rn, CASE WHEN atr IS NULL THEN 0.02 ELSE 0.7 * 0.02 + 0.3 * least(greatest(atr / close, 0.01), 0.5) END::DOUBLE AS y FROM sg0 WHERE rn = 1 UNION ALL
          SELECT n.symbol, n.rn, CASE WHEN n.atr IS NULL THEN sm.y ELSE 0.7 * sm.y + 0.3 * least(greatest(n.atr / n.close, 0.01), 0.5) END FROM sm JOIN sg0 n ON n.symbol = sm.symbol AND n.rn = sm.rn + 1),
   sg1 AS (SELECT sg0.*, sm.y AS smoothed, CASE WHEN coalesce(atr / nullif(close, 0) > 0.3, FALSE) THEN 'HOLD'
             WHEN prediction = 2 OR (prediction = 1 AND CASE WHEN coalesce(rsi, 0) = 0 THEN 50 ELSE rsi END > 40 AND CASE WHEN coalesce(rsi, 0) = 0 THEN 50 ELSE rsi END < 60) THEN 'BUY'
             WHEN prediction = 0 THEN 'SHORT' ELSE 'HOLD' END AS proposed FROM sg0 JOIN sm USING (symbol, rn)),
   sg AS (SELECT *, CASE WHEN coalesce(atr / nullif(close, 0), smoothed) > 3 * smoothed THEN 'HOLD' WHEN proposed = 'HOLD' OR volatility > 0.3 OR volume < 40 THEN 'HOLD'
             WHEN prediction = 2 THEN 'BUY' WHEN prediction = 0 THEN 'SHORT' ELSE 'HOLD' END AS signal FROM sg1)"""


def with_signals(spark, sf):
    bars = stage(strip_zero_bars(bars30(spark, sf)), "bars")
    base = stage(X.base_features(bars), "features").select("symbol", "ts", "high", "low", "close", "volume", "atr", "rsi")
    base = X.rolling_volatility(X.market_state_simple(base, "prediction"), 20, 5)
    tenth = {"atr": F.col("atr") * 0.1, "volatility": F.coalesce("volatility", F.lit(0.0)) * 0.1}
    base = stage(base.withColumns(tenth), "base")
    smooth = S.smoothed_volatility(base)
    signal = S.entry_signal(
        prediction=F.col("prediction"),
        close=F.col("close"),
        atr=F.col("atr"),
        rsi=F.col("rsi"),
        volatility=F.col("volatility"),
        volume=F.col("volume"),
        smoothed=F.col("smoothed"),
        risk=0.3,
        min_volume=40,
    )
    return smooth.withColumn("signal", signal)


@query("smoothed_volatility", f"WITH RECURSIVE {SIGNALS} SELECT symbol, ts, R(smoothed) AS smoothed FROM sg", ("bars30",))
def _(spark, sf):
    return rounded(with_signals(spark, sf).select("symbol", "ts", "smoothed"), "smoothed")


@query("entry_signal", f"WITH RECURSIVE {SIGNALS} SELECT symbol, ts, prediction, signal FROM sg", ("bars30",))
def _(spark, sf):
    return with_signals(spark, sf).select("symbol", "ts", "prediction", "signal")


# One row after the other: the last trade and the day's trades so far decide.
CAPPED = f"""{SIGNALS}, sgn AS (SELECT *, ts::DATE AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM sg WHERE signal <> 'HOLD'),
   cap AS (SELECT symbol, k, d, ts AS last, 1 AS cnt, TRUE AS ok FROM sgn WHERE k = 1 UNION ALL
     SELECT symbol, k, d, CASE WHEN ok THEN ts ELSE last END, cnt + ok::INT, ok FROM (
       SELECT *, cnt < CASE WHEN volatility > 0.15 THEN 1 ELSE 3 END AND epoch_us(ts) - epoch_us(last) >= 3600000000 AS ok FROM (
         SELECT n.symbol, n.k, n.d, n.ts, n.volatility, cap.last, CASE WHEN n.d = cap.d THEN cap.cnt ELSE 0 END AS cnt FROM cap JOIN sgn n ON n.symbol = cap.symbol AND n.k = cap.k + 1))),
   capped AS (SELECT sgn.* FROM sgn JOIN cap USING (symbol, k) WHERE ok)"""


def capped(spark, sf):
    return S.daily_cap(stage(with_signals(spark, sf), "signals"), high=0.15, min_gap_minutes=60)


@query("daily_cap", f"WITH RECURSIVE {CAPPED} SELECT symbol, ts, signal FROM capped", ("bars30",))
def _(spark, sf):
    return capped(spark, sf).select("symbol", "ts", "signal")


@query(
    "kelly_shares",
    f"""WITH RECURSIVE {SIGNALS} SELECT symbol, ts, CASE WHEN close > 0.1 AND close < 10000 THEN floor(50000 * greatest(0.01, least(0.25 * greatest(0.5, 1 - volatility / 0.1)
          * greatest(0.7, CASE prediction WHEN 2 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END), 0.1))::DOUBLE / close) ELSE 0 END::BIGINT AS shares FROM sg""",
    ("bars30",),
)
def _(spark, sf):
    shares = S.kelly_shares(F.col("close"), F.col("volatility"), S.confidence_of(F.col("prediction")))
    return with_signals(spark, sf).select("symbol", "ts", shares.alias("shares"))


FLAT = """costs AS (SELECT *, executed * shares AS v FROM (SELECT *, price * (1 + CASE WHEN action IN ('BUY', 'COVER') THEN 1 ELSE -1 END * rate) AS executed
   FROM (SELECT *, CASE WHEN shares > 25 THEN 0.0012 ELSE 0.0003 END::DOUBLE AS rate FROM ledger)))"""


def costed(spark, sf):
    return S.costs_flat(ledger(spark, sf).withColumn("volatility", F.when(F.col("shares") > 25, 0.08).when(F.col("shares") > 10, 0.01)))


@query(
    "costs_flat",
    f"WITH {FLAT} SELECT event_id, R(executed) AS executed_price, R(greatest(v * 0.0005, 1)) AS commission, R(v * rate) AS slippage_cost FROM costs",
    ("ledger",),
)
def _(spark, sf):
    cols = ["executed_price", "commission", "slippage_cost"]
    return rounded(costed(spark, sf).select("event_id", *cols), *cols)


@query("cost_totals", f"WITH {FLAT} SELECT symbol, R(sum(greatest(v * 0.0005, 1))) AS total_commission, R(sum(v * rate)) AS total_slippage FROM costs GROUP BY 1", ("ledger",))
def _(spark, sf):
    return rounded(S.cost_totals(costed(spark, sf)), "total_commission", "total_slippage")


@query(
    "costs_per_share",
    """SELECT event_id, R8(least(greatest(shares * 0.005, 1.0)::DOUBLE, shares * price * 0.01) + shares * price * 0.0000278 + least(shares * 0.000145, 8.30)) AS total_cost,
              R8(0.0008 + least(shares / 10000, 0.001)) AS slippage_rate FROM ledger""",
    ("ledger",),
)
def _(spark, sf):
    return rounded(S.costs_per_share(ledger(spark, sf)).select("event_id", "total_cost", "slippage_rate"), "total_cost", "slippage_rate", digits=8)


# Open trades: every capped signal opens one; they may overlap, and each goes on to its own exit.
PATHS = f"""{CAPPED}, ent AS (SELECT symbol, ts, CASE signal WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END AS side, close AS price, atr FROM capped),
   paths AS (SELECT sg.symbol, sg.ts, sg.close, sg.atr, ent.ts AS entry_ts, ent.price AS entry_price, ent.side, ent.atr AS entry_atr FROM sg JOIN ent ON sg.symbol = ent.symbol AND sg.ts > ent.ts),
   lv0 AS (SELECT *, max(close) OVER t AS hi, min(close) OVER t AS lo, CASE WHEN entry_atr > 0 THEN 2 * entry_atr ELSE entry_price * 0.05 END AS reach
           FROM paths WINDOW t AS (PARTITION BY symbol, entry_ts ORDER BY ts)),
   lv1 AS (SELECT *, CASE WHEN side = 'LONG' THEN entry_price - reach ELSE entry_price + reach END AS stop0, CASE WHEN side = 'LONG' THEN entry_price + 2 * reach ELSE entry_price - 2 * reach END AS target,
             CASE WHEN side = 'LONG' THEN greatest(hi, entry_price) ELSE least(lo, entry_price) END AS peak FROM lv0),
   lv2 AS (SELECT *, CASE WHEN side = 'LONG' AND (peak - entry_price) / entry_price > 0.05 THEN greatest(stop0, peak * 0.99)
             WHEN side = 'SHORT' AND (entry_price - peak) / entry_price > 0.05 THEN least(stop0, peak * 1.01) ELSE stop0 END AS stop FROM lv1),
   lv3 AS (SELECT *, CASE WHEN side = 'LONG' AND close <= stop OR side = 'SHORT' AND close >= stop THEN 'stop'
             WHEN side = 'LONG' AND close >= target OR side = 'SHORT' AND close <= target THEN 'target' END AS touched FROM lv2),
   lv AS (SELECT * FROM (SELECT *, count(touched) OVER (PARTITION BY symbol, entry_ts ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lv3) WHERE before = 0)"""


def paths(spark, sf, until="touched"):
    signals = stage(with_signals(spark, sf), "signals")
    taken = S.daily_cap(signals, high=0.15, min_gap_minutes=60)
    entries = taken.select("symbol", "ts", F.when(F.col("signal") == "BUY", "LONG").otherwise("SHORT").alias("side"), F.col("close").alias("price"), "atr")
    return S.trade_paths(signals.select("symbol", "ts", "close", "atr"), stage(entries, "entries"), until=until)


@query(
    "open_trades",
    f"WITH RECURSIVE {CAPPED} SELECT sg.symbol, sg.ts, c.ts AS entry_ts, c.close AS entry_price FROM sg ASOF JOIN capped c ON sg.symbol = c.symbol AND sg.ts > c.ts",
    ("bars30",),
)
def _(spark, sf):
    """The newest trade entered before each bar."""
    signals = stage(with_signals(spark, sf), "signals")
    entries = S.daily_cap(signals, high=0.15, min_gap_minutes=60).select("symbol", "ts", "signal", F.col("close").alias("price"), "atr").withColumnRenamed("signal", "side")
    return S.with_open_trade(signals.select("symbol", "ts"), stage(entries, "entries")).select("symbol", "ts", "entry_ts", "entry_price")


@query("exit_levels", f"WITH RECURSIVE {PATHS} SELECT symbol, ts, entry_ts, side, R(stop) AS stop, R(target) AS target, touched FROM lv", ("bars30",))
def _(spark, sf):
    levels = paths(spark, sf).select("symbol", "ts", "entry_ts", "side", "stop", "target", "touched")
    return rounded(levels, "stop", "target")


@query(
    "first_exit",
    f"""WITH RECURSIVE {PATHS} SELECT symbol, entry_ts, side, entry_price, min(ts) FILTER (WHERE touched IS NOT NULL) AS exit_ts,
          arg_min(close, ts) FILTER (WHERE touched IS NOT NULL) AS exit_price, arg_min(touched, ts) FILTER (WHERE touched IS NOT NULL) AS reason FROM lv GROUP BY 1, 2, 3, 4""",
    ("bars30",),
)
def _(spark, sf):
    return S.first_exit(paths(spark, sf))


@query(
    "exit_signals",
    f"""WITH RECURSIVE {PATHS}, x AS (SELECT symbol, ts, entry_ts, side, epoch_us(ts) - epoch_us(entry_ts) > 14400000000 AS held,
          coalesce(CASE side WHEN 'LONG' THEN close / entry_price - 1 ELSE entry_price / close - 1 END > 0.03, FALSE) AS gained,
          coalesce(atr > 0 AND CASE side WHEN 'LONG' THEN close - entry_price ELSE entry_price - close END > 2 * atr, FALSE) AS beyond FROM paths)
        SELECT * EXCLUDE before FROM (SELECT *, count(reason) OVER (PARTITION BY symbol, entry_ts ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT *, CASE WHEN held THEN 'held' WHEN gained THEN 'gain' WHEN beyond THEN 'range' END AS reason FROM x)) WHERE before = 0""",
    ("bars30",),
)
def _(spark, sf):
    return paths(spark, sf, "reason").select("symbol", "ts", "entry_ts", "side", "held", "gained", "beyond", "reason")


# ---------------------------------------------------------------------------------------------------------
# Ledger. Intervals along cumulative shares, matched by an overlap join.

LOTS = """sd AS (SELECT *, CASE WHEN action IN ('BUY', 'SELL') THEN 'LONG' ELSE 'SHORT' END AS side, action IN ('BUY', 'SHORT') AS opens FROM ledger),
   run AS (SELECT *, sum(CASE WHEN opens THEN shares ELSE 0 END) OVER o AS opened, sum(CASE WHEN opens THEN 0 ELSE shares END) OVER o AS closed FROM sd
           WINDOW o AS (PARTITION BY symbol, side ORDER BY ts, event_id)),
   lost AS (SELECT *, greatest(max(closed - opened) OVER (PARTITION BY symbol, side ORDER BY ts, event_id), 0) AS lost FROM run),
   net AS (SELECT *, closed - lost AS matched, coalesce(lag(closed - lost) OVER (PARTITION BY symbol, side ORDER BY ts, event_id), 0) AS matched_before FROM lost),
   op AS (SELECT symbol, side, ts, event_id, price, shares, opened - shares AS a, opened AS z FROM net WHERE opens),
   cl AS (SELECT symbol, side, ts, event_id, price, shares, matched_before AS a, matched AS z FROM net WHERE NOT opens AND matched > matched_before),
   pr AS (SELECT op.symbol, op.side, op.ts AS entry_ts, op.price AS entry_price, cl.ts AS exit_ts, cl.price AS exit_price, least(op.z, cl.z) - greatest(op.a, cl.a) AS shares,
            op.shares AS lot, op.z - greatest(op.a, cl.a) AS remaining, CASE op.side WHEN 'LONG' THEN 1 ELSE -1 END AS dir
          FROM op JOIN cl ON op.symbol = cl.symbol AND op.side = cl.side AND op.a < cl.z AND cl.a < op.z),
   tot AS (SELECT symbol, side, max(matched) AS done FROM net GROUP BY 1, 2),
   rest AS (SELECT op.*, z - greatest(a, done) AS open_shares, CASE op.side WHEN 'LONG' THEN 1 ELSE -1 END AS dir FROM op JOIN tot USING (symbol, side) WHERE z > done)"""


def profit(per: str) -> str:
    return f"(exit_price - entry_price) * shares * dir - greatest(entry_price * lot * 0.0005, 1) * shares / {per} - greatest(exit_price * shares * 0.0005, 1)"


def match_sql(per: str) -> str:
    return f"""WITH {LOTS} SELECT symbol, side, entry_ts, entry_price, exit_ts, exit_price, shares::BIGINT AS shares, R({profit(per)}) AS profit,
       R((epoch_us(exit_ts) - epoch_us(entry_ts)) / 3.6e9) AS holding_hours FROM pr"""


def money(pairs):
    return rounded(pairs, "profit", "holding_hours")


@query("match_fifo", match_sql("lot"), ("ledger",))
def _(spark, sf):
    return money(L.match_fifo(ledger(spark, sf)))


@query("match_fifo_compat", match_sql("remaining"), ("ledger",))
def _(spark, sf):
    return money(L.match_fifo(ledger(spark, sf), compat=True))


LAST = "last_p AS (SELECT symbol, max(ts) AS last_ts, last(close ORDER BY ts) AS last_price FROM bars_user GROUP BY 1)"


def last_prices(spark, sf):
    return bars_user(spark, sf).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last_price"))


def _open_sql(commission: str) -> str:
    return f"""WITH {LOTS}, {LAST} SELECT symbol, side, ts AS entry_ts, price AS entry_price, last_ts AS exit_ts, last_price AS exit_price, open_shares::BIGINT AS shares,
       R((last_price - price) * open_shares * dir - {commission}) AS profit, R((epoch_us(last_ts) - epoch_us(ts)) / 3.6e9) AS holding_hours FROM rest JOIN last_p USING (symbol)"""


@query("mark_open", _open_sql("greatest(price * shares * 0.0005, 1) * open_shares / shares"), ("ledger", "bars_user"))
def _(spark, sf):
    return money(L.mark_open(ledger(spark, sf), last_prices(spark, sf)))


@query("mark_open_compat", _open_sql("greatest(price * shares * 0.0005, 1)"), ("ledger", "bars_user"))
def _(spark, sf):
    return money(L.mark_open(ledger(spark, sf), last_prices(spark, sf), compat=True))


PAIRS = f"""{LOTS}, pairs AS (SELECT symbol, entry_ts, exit_ts, {profit('lot')} AS profit FROM pr)"""
STATS = f"""{PAIRS}, stats AS (SELECT symbol, count(*) AS total_trades, count(*) FILTER (WHERE profit > 0) AS winning_trades,
   count(*) FILTER (WHERE profit > 0) / count(*) AS win_rate, sum(profit) AS total_profit FROM pairs GROUP BY 1)"""


@query("trade_stats", f"WITH {STATS} SELECT symbol, total_trades, winning_trades, R(win_rate) AS win_rate, R(total_profit) AS total_profit FROM stats", ("ledger",))
def _(spark, sf):
    return rounded(L.trade_stats(L.match_fifo(ledger(spark, sf))), "win_rate", "total_profit")


CURVE = """flows AS (SELECT symbol, ts, CASE WHEN action IN ('BUY', 'COVER') THEN -1 ELSE 1 END * price * shares - greatest(price * shares * 0.0005, 1) AS flow,
     CASE WHEN action IN ('BUY', 'COVER') THEN shares ELSE -shares END AS moved FROM ledger),
   curve AS (SELECT b.symbol, b.ts, coalesce(sum(moved), 0) AS position, 50000 + coalesce(sum(flow), 0) + coalesce(sum(moved), 0) * any_value(b.close) AS portfolio_value
             FROM bars_user b LEFT JOIN flows f ON f.symbol = b.symbol AND f.ts <= b.ts GROUP BY 1, 2)"""


@query("equity_curve", f"WITH {CURVE} SELECT symbol, ts, position::BIGINT AS position, R(portfolio_value) AS portfolio_value FROM curve", ("ledger", "bars_user"))
def _(spark, sf):
    return rounded(L.equity_curve(ledger(spark, sf), bars_user(spark, sf)), "portfolio_value")


@query(
    "margin_requirement",
    f"""WITH {LOTS}, {LAST}, pos AS (SELECT symbol, dir * open_shares AS shares, 'account_' || (symbol::INT % 7) AS account FROM rest)
        SELECT account, R(sum(abs(shares * last_price))) AS gross_value, R(sum(abs(shares * last_price)) * 0.25) AS margin FROM pos JOIN last_p USING (symbol) GROUP BY 1""",
    ("ledger", "bars_user"),
)
def _(spark, sf):
    rest = L.lot_segments(ledger(spark, sf)).filter("closed is null")
    signed = F.col("shares") * F.when(F.col("side") == "LONG", 1).otherwise(-1)
    account = F.concat(F.lit("account_"), (F.col("symbol").cast("int") % 7).cast("string"))
    positions = rest.select(account.alias("account"), "symbol", signed.alias("shares"))
    prices = last_prices(spark, sf).select("symbol", F.col("last_price").alias("price"))
    return rounded(L.margin_requirement(positions, prices), "gross_value", "margin")


@query(
    "day_trade_check",
    f"""WITH {LOTS}, days AS (SELECT DISTINCT symbol, date_trunc('day', ts)::TIMESTAMP AS day FROM ledger),
        n AS (SELECT symbol, date_trunc('day', exit_ts)::TIMESTAMP AS day, count(*) AS n FROM pr WHERE entry_ts::DATE = exit_ts::DATE GROUP BY 1, 2),
        r AS (SELECT symbol, day, coalesce(n, 0) AS day_trades, sum(coalesce(n, 0)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS recent
              FROM days LEFT JOIN n USING (symbol, day))
        SELECT *, symbol::INT % 3 <> 0 AND recent > 3 AS flagged FROM r""",
    ("ledger",),
)
def _(spark, sf):
    fills = ledger(spark, sf)
    size = F.when(F.col("symbol").cast("int") % 3 == 0, 30_000.0).otherwise(20_000.0)
    accounts = fills.select("symbol", size.alias("account_size")).distinct()
    return L.day_trade_check(L.match_fifo(fills), fills, accounts)


# ---------------------------------------------------------------------------------------------------------
# Performance.

PERFORMANCE = """pf0 AS (SELECT symbol, ts, portfolio_value AS v, portfolio_value / nullif(lag(portfolio_value) OVER w, 0) - 1 AS ret, max(portfolio_value) OVER w AS peak
     FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
   pf1 AS (SELECT symbol, first(v ORDER BY ts) AS initial_value, last(v ORDER BY ts) AS final_value, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::BIGINT AS total_days,
     avg(ret) AS m, stddev_samp(ret) AS s, abs(min((v - peak) / nullif(peak, 0))) AS max_drawdown FROM pf0 GROUP BY 1),
   perf AS (SELECT symbol, initial_value, final_value, total_days, final_value / nullif(initial_value, 0) - 1 AS total_return,
     CASE WHEN total_days > 0 AND initial_value > 0 AND final_value >= 0 THEN pow(final_value / initial_value, 252 / total_days) - 1 ELSE 0 END AS annual_return,
     coalesce(max_drawdown, 0) AS max_drawdown, CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END AS sharpe_ratio FROM pf1)"""
_PERF = ["initial_value", "final_value", "total_return", "annual_return", "max_drawdown", "sharpe_ratio"]


@query(
    "performance",
    f"WITH {PERFORMANCE.format(source='equity')} SELECT symbol, total_days, {', '.join(f'R({c}) AS {c}' for c in _PERF)} FROM perf",
    ("equity",),
)
def _(spark, sf):
    return rounded(R.performance(stage(equity(spark, sf), "equity"), EQUITY), *_PERF)


MONTHS = """mo AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, first(portfolio_value ORDER BY ts) AS start_value, last(portfolio_value ORDER BY ts) AS end_value
     FROM {source} GROUP BY 1, 2),
   months AS (SELECT *, (end_value - start_value) / start_value AS monthly_return FROM mo WHERE start_value > 0),
   win AS (SELECT symbol, count(*) AS total_months, count(*) FILTER (WHERE monthly_return > 0) AS winning_months, count(*) FILTER (WHERE monthly_return > 0) / count(*) AS monthly_win_rate
           FROM months GROUP BY 1)"""


@query(
    "monthly_returns",
    f"WITH {MONTHS.format(source='equity')} SELECT symbol, month, R(start_value) AS start_value, R(end_value) AS end_value, R(monthly_return) AS monthly_return FROM months",
    ("equity",),
)
def _(spark, sf):
    return rounded(R.monthly_returns(equity(spark, sf), EQUITY), "start_value", "end_value", "monthly_return")


@query(
    "monthly_win_rate",
    f"WITH {MONTHS.format(source='equity')} SELECT symbol, total_months, winning_months, R(monthly_win_rate) AS monthly_win_rate FROM win",
    ("equity",),
)
def _(spark, sf):
    return rounded(R.monthly_win_rate(equity(spark, sf), EQUITY), "monthly_win_rate")


METRICS = f"{PERFORMANCE.format(source='equity')}, {MONTHS.format(source='equity')}, mt AS (SELECT symbol, annual_return, max_drawdown, monthly_win_rate FROM perf JOIN win USING (symbol))"


def metrics(spark, sf):
    curve = stage(equity(spark, sf), "equity")
    rates = R.performance(curve, EQUITY).select("symbol", "annual_return", "max_drawdown")
    return rates.join(R.monthly_win_rate(curve, EQUITY).select("symbol", "monthly_win_rate"), "symbol")


_RATES = ("annual_return", "max_drawdown", "monthly_win_rate")


@query(
    "target_assessment",
    f"""WITH {METRICS}, f AS (SELECT *, annual_return - 0.30 AS annual_return_gap, 0.10 - max_drawdown AS max_drawdown_gap, monthly_win_rate - 0.45 AS monthly_win_rate_gap,
          annual_return >= 0.30::DOUBLE * 0.8::DOUBLE AS annual_return_feasible, max_drawdown <= 0.10::DOUBLE * 1.2::DOUBLE AS max_drawdown_feasible,
          monthly_win_rate >= 0.45::DOUBLE * 0.9::DOUBLE AS monthly_win_rate_feasible FROM mt),
        s AS (SELECT *, annual_return_feasible::INT + max_drawdown_feasible::INT + monthly_win_rate_feasible::INT AS met FROM f)
        SELECT symbol, {', '.join(f'R({c}) AS {c}, R({c}_gap) AS {c}_gap, {c}_feasible' for c in _RATES)}, R(met / 3) AS score, met >= 2 AS feasible,
          met AS targets_met, CASE WHEN NOT annual_return_feasible THEN 'annual_return' WHEN NOT max_drawdown_feasible THEN 'max_drawdown'
            WHEN NOT monthly_win_rate_feasible THEN 'monthly_win_rate' END AS missed FROM s""",
    ("equity",),
)
def _(spark, sf):
    targets = {**R.TARGETS, "monthly_win_rate": 0.45}
    out = R.target_assessment(metrics(spark, sf), targets)
    return rounded(out, *_RATES, *[f"{c}_gap" for c in _RATES], "score")


@query(
    "target_ratios",
    f"""WITH {METRICS}, r AS (SELECT *, annual_return / 0.20 AS annual_return_ratio, 0.12 / CASE WHEN max_drawdown > 0 THEN max_drawdown END AS max_drawdown_ratio,
          monthly_win_rate / 0.58 AS monthly_win_rate_ratio, annual_return >= 0.20 AND max_drawdown <= 0.12 AND monthly_win_rate >= 0.58 AS all_achieved FROM mt)
        SELECT symbol, {', '.join(f'R({c}) AS {c}, R({c}_ratio) AS {c}_ratio' for c in _RATES)}, all_achieved,
          R((annual_return_ratio + max_drawdown_ratio + monthly_win_rate_ratio) / 3) AS mean_ratio,
          CASE WHEN max_drawdown > 0.15 THEN 'high' WHEN max_drawdown > 0.10 THEN 'medium' ELSE 'low' END AS risk_tier FROM r""",
    ("equity",),
)
def _(spark, sf):
    out = R.target_ratios(metrics(spark, sf))
    return rounded(out, *_RATES, *[f"{c}_ratio" for c in _RATES], "mean_ratio")


_SUMS = ("total_return", "monthly_win_rate", "total_commission", "total_slippage", "initial_value", "final_value")


@query(
    "performance_report",
    f"""WITH {STATS}, {FLAT}, {CURVE}, {PERFORMANCE.format(source='curve')}, {MONTHS.format(source='curve')},
        ct AS (SELECT symbol, sum(greatest(v * 0.0005, 1)) AS total_commission, sum(v * rate) AS total_slippage FROM costs GROUP BY 1)
        SELECT symbol, total_days, {', '.join(f'round(coalesce({c}, 0)::DOUBLE, 4) AS {c}' for c in ('annual_return', 'max_drawdown', 'win_rate', 'sharpe_ratio'))},
          {', '.join(f'R(coalesce({c}, 0)) AS {c}' for c in _SUMS)},
          {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_trades', 'winning_trades', 'winning_months', 'total_months'))}
        FROM perf LEFT JOIN stats USING (symbol) LEFT JOIN win USING (symbol) LEFT JOIN ct USING (symbol)""",
    ("ledger", "bars_user"),
)
def _(spark, sf):
    fills = stage(ledger(spark, sf), "ledger")
    curve = stage(L.equity_curve(fills, bars_user(spark, sf)), "curve")
    report = R.performance_report(curve, L.match_fifo(fills), S.cost_totals(costed(spark, sf)), pair_axis=FILLS)
    return rounded(report, *_SUMS)

