"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom import catalogue_sql as S
from barloom.functions.expr import CLOSE, HIGH, LOW, OPEN, VOLUME, Node, Unit, const, n
from barloom.operators import memory, parity, quality, ranking, regimes, simulate, splits, stats
from barloom.operators.ordinals import ordinals
from barloom.plans.compiler import canonical, evaluate
from barloom.sources import bars as B
from barloom.streaming import incremental, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_events(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded as SQL engines do, by the scaled double; Spark's own rounding goes by the shortest decimal text, which near a tie may say otherwise."""
    scale = 10.0**DIGITS
    return df.withColumns({c: F.round(F.col(c) * scale) / scale for c in columns})


def r(x: str) -> str:
    return f"round({x}, {DIGITS})"


# ---- sources -------------------------------------------------------------------------


@query(S.with_() + "SELECT symbol, bar_idx, ts, open, high, low, close, volume FROM bars")
def bars_build(spark, d):
    return bars(spark, d)


@query(S.with_() + "SELECT symbol, bar_idx - 100 AS bar_idx, ts, close FROM bars WHERE bar_idx >= 100 AND bar_idx < 300")
def bars_slice(spark, d):
    return B.slice_bars(bars(spark, d), 100, 300, rebase=True).select("symbol", "bar_idx", "ts", "close")


@query(S.with_() + "SELECT symbol, bar_idx, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) <= 50")
def bars_tail(spark, d):
    return B.tail_bars(bars(spark, d), 50).select("symbol", "bar_idx", "close")


@query(S.with_() + "SELECT symbol, bar_idx, close FROM bars QUALIFY bar_idx < floor(count(*) OVER (PARTITION BY symbol) * (1 - 0.2))")
def research_view(spark, d):
    return B.research_view(bars(spark, d)).select("symbol", "bar_idx", "close")


@query(S.with_() + "SELECT symbol, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol")
def discover_series(spark, d):
    return bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- expressions ---------------------------------------------------------------------


def expressions(**named: Node):
    numbers = [k for k, v in named.items() if v.op not in ("gt", "lt", "and", "or", "not", "cross_above", "cross_below")]

    def run(spark, d):
        return rounded(evaluate(bars(spark, d), named, ["symbol", "bar_idx"]), *numbers)

    return run


def expression_query(name: str, sql: str, **named: Node) -> None:
    QUERIES[name] = expressions(**named)
    ORACLES[name] = sql


_ret1 = n("ret", CLOSE, period=1)
_sma10 = n("sma", CLOSE, period=10)
expression_query("dsl_abs_neg", S.point(a=r("abs(close / nullif(pc, 0) - 1)"), b=r("-(close / nullif(pc, 0) - 1)")), a=n("abs", _ret1), b=n("neg", _ret1))
expression_query("dsl_add_sub", S.point(a=r("high + low"), b=r("close - open")), a=n("add", HIGH, LOW), b=n("sub", CLOSE, OPEN))
expression_query(
    "dsl_gt_lt",
    S.point(a=f"coalesce(close > {S.full('close', 2, 'min(close) OVER ' + S.fr(2))}, false)", b="coalesce(close < open, false)"),
    a=n("gt", CLOSE, n("lowest", CLOSE, period=2)),
    b=n("lt", CLOSE, OPEN),
)
expression_query(
    "dsl_and_or_not",
    S.point(a="close > open AND high > close", b="close > open OR low < close", c=f"NOT coalesce(close > {S.full('close', 5, S.avg('close', 5))}, false)"),
    a=n("and", n("gt", CLOSE, OPEN), n("gt", HIGH, CLOSE)),
    b=n("or", n("gt", CLOSE, OPEN), n("lt", LOW, CLOSE)),
    c=n("not", n("gt", CLOSE, n("sma", CLOSE, period=5))),
)
expression_query("dsl_constant", S.point(a="close > 100.5", b="volume < 4"), a=n("gt", CLOSE, const(100.5, Unit.PRICE)), b=n("lt", VOLUME, const(4, Unit.VOLUME)))
_CROSS = S.with_(f" c AS (SELECT *, {S.full('close', 10, S.avg('close', 10))} AS m FROM bars)")
expression_query("dsl_cross_above", _CROSS + f"SELECT symbol, bar_idx, coalesce(lag(close) OVER ({S.W}) <= lag(m) OVER ({S.W}) AND close > m, false) AS a FROM c", a=n("cross_above", CLOSE, _sma10))
expression_query("dsl_cross_below", _CROSS + f"SELECT symbol, bar_idx, coalesce(lag(close) OVER ({S.W}) >= lag(m) OVER ({S.W}) AND close < m, false) AS a FROM c", a=n("cross_below", CLOSE, _sma10))
expression_query("dsl_sma", S.point(a=r(S.full("close", 10, S.avg("close", 10))), b=r(S.full("volume", 5, S.avg("volume", 5)))), a=_sma10, b=n("sma", VOLUME, period=5))
expression_query(
    "dsl_highest_lowest",
    S.point(a=S.full("high", 20, f"max(high) OVER {S.fr(20)}"), b=S.full("low", 20, f"min(low) OVER {S.fr(20)}")),
    a=n("highest", HIGH, period=20),
    b=n("lowest", LOW, period=20),
)
expression_query("dsl_stdev", S.point(a=r(S.full("close", 20, f"stddev_pop(close) OVER {S.fr(20)}"))), a=n("stdev", CLOSE, period=20))
_SD = f"stddev_pop(close) OVER {S.fr(20)}"
expression_query("dsl_zscore", S.point(a=r(f"CASE WHEN count(close) OVER {S.fr(20)} = 20 AND {_SD} > 0 THEN (close - {S.avg('close', 20)}) / {_SD} END")), a=n("zscore", CLOSE, period=20))
expression_query(
    "dsl_rank",
    S.with_(f" k AS (SELECT *, list(close) OVER {S.fr(20)} AS h FROM bars)") + f"SELECT symbol, bar_idx, {r('CASE WHEN len(h) = 20 THEN len(list_filter(h, lambda v: v <= close)) / 20.0 END')} AS a FROM k",
    a=n("rank", CLOSE, period=20),
)
expression_query("dsl_delta", S.point(a=r(f"close - lag(close, 5) OVER ({S.W})")), a=n("delta", CLOSE, period=5))
expression_query("dsl_ret", S.point(a=r(f"close / nullif(lag(close, 5) OVER ({S.W}), 0) - 1")), a=n("ret", CLOSE, period=5))
expression_query(
    "dsl_er",
    S.with_(S.STEP) + f"SELECT symbol, bar_idx, {r(f'CASE WHEN count(ad) OVER {S.fr(24)} = 24 AND sum(ad) OVER {S.fr(24)} > 0 THEN abs(close - c24) / sum(ad) OVER {S.fr(24)} END')} AS a FROM st",
    a=n("efficiency_ratio", CLOSE, period=24),
)
_UP, _DOWN = f"avg(greatest(d, 0)) OVER {S.fr(14)}", f"avg(greatest(-d, 0)) OVER {S.fr(14)}"
expression_query(
    "dsl_rsi",
    S.with_(S.STEP) + f"SELECT symbol, bar_idx, {r(f'CASE WHEN count(d) OVER {S.fr(14)} = 14 THEN CASE WHEN {_UP} + {_DOWN} > 0 THEN 100 * {_UP} / ({_UP} + {_DOWN}) ELSE 50.0 END END')} AS a FROM st",
    a=n("rsi", CLOSE, period=14),
)
expression_query("dsl_atr", S.with_(S.TR) + f"SELECT symbol, bar_idx, {r(S.ATR14)} AS a FROM tr", a=n("atr", period=14))
_WIDE = f"(max(high) OVER {S.fr(14)} - min(low) OVER {S.fr(14)})"
expression_query(
    "dsl_chop",
    S.with_(S.TR) + f"SELECT symbol, bar_idx, {r(f'CASE WHEN count(tr) OVER {S.fr(14)} = 14 AND {_WIDE} > 0 AND sum(tr) OVER {S.fr(14)} > 0 THEN log10(sum(tr) OVER {S.fr(14)} / {_WIDE}) / log10(14) END')} AS a FROM tr",
    a=n("chop", period=14),
)


def _ema(alpha: str, name: str) -> str:
    return f" {name} AS (SELECT symbol, bar_idx, close AS e FROM bars WHERE bar_idx = 0 UNION ALL SELECT b.symbol, b.bar_idx, x.e + {alpha} * (b.close - x.e) FROM {name} x JOIN bars b ON b.symbol = x.symbol AND b.bar_idx = x.bar_idx + 1)"


expression_query("dsl_ema", S.with_(_ema("(2.0 / 11)", "em"), recursive=True) + f"SELECT symbol, bar_idx, {r('e')} AS a FROM em", a=n("ema", CLOSE, period=10))
MACD = n("sub", n("ema", CLOSE, period=12), n("ema", CLOSE, period=26))
SIGNAL = n("and", n("gt", n("zscore", MACD, period=50), const(1.0, Unit.ZSCORE)), n("gt", CLOSE, _sma10))
_MACD_SQL = S.with_(
    _ema("(2.0 / 13)", "e12"),
    _ema("(2.0 / 27)", "e26"),
    f" mc AS (SELECT b.*, e12.e - e26.e AS m, {S.full('close', 10, S.avg('close', 10))} AS m10 FROM bars b JOIN e12 USING (symbol, bar_idx) JOIN e26 USING (symbol, bar_idx))",
    f" mz AS (SELECT *, CASE WHEN count(m) OVER {S.fr(50)} = 50 AND stddev_pop(m) OVER {S.fr(50)} > 0 THEN (m - {S.avg('m', 50)}) / stddev_pop(m) OVER {S.fr(50)} END AS z FROM mc)",
    " ms AS (SELECT *, coalesce(z > 1, false) AND coalesce(close > m10, false) AS signal FROM mz)",
    recursive=True,
)


@query(_MACD_SQL + f"SELECT symbol, bar_idx, {r('m')} AS macd, {r('z')} AS z, signal FROM ms")
def dsl_macd_zscore_signal(spark, d):
    out = evaluate(bars(spark, d), {"macd": MACD, "z": n("zscore", MACD, period=50), "signal": canonical(SIGNAL)}, ["symbol", "bar_idx"])
    return rounded(out, "macd", "z")


@query(_MACD_SQL + f"SELECT symbol, count(*) AS n_bars, CAST(sum(CASE WHEN signal THEN 1 ELSE 0 END) AS BIGINT) AS n_signals, {r('avg(CASE WHEN signal THEN 1.0 ELSE 0.0 END)')} AS density FROM ms GROUP BY symbol")
def signal_density(spark, d):
    out = evaluate(bars(spark, d), {"signal": SIGNAL}, ["symbol"])
    return rounded(out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if("signal").alias("n_signals"), F.avg(F.col("signal").cast("double")).alias("density")), "density")


# ---- quality -------------------------------------------------------------------------

_QA = S.with_(
    f" q AS (SELECT *, ts - lag(ts) OVER ({S.W}) AS dt, first_value(ts) OVER ({S.W}) AS f FROM bars)",
    """ k AS (SELECT symbol, count(*) FILTER (dt < 0) AS backwards, count(*) FILTER (dt = 0) AS dup, count(*) FILTER ((ts - f) % 3600 <> 0) AS mis, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS ohlc,
      count(*) FILTER (least(open, high, low, close) <= 0) AS pos, count(*) FILTER (volume < 0) AS neg, count(*) FILTER (dt > 3600) AS gaps, count(*) FILTER (volume = 0) AS zero, count(*) FILTER (0.01 / greatest(close, 0.01) > 0.01) AS coarse FROM q GROUP BY symbol)""",
)


@query(
    _QA
    + """, u AS (SELECT symbol, unnest([
      {'c': 'non_empty', 's': 'error', 'o': 0}, {'c': 'monotonic_time', 's': 'error', 'o': backwards}, {'c': 'no_duplicate_timestamps', 's': 'error', 'o': dup}, {'c': 'timeframe_alignment', 's': 'error', 'o': mis},
      {'c': 'finite_values', 's': 'error', 'o': 0}, {'c': 'ohlc_invariants', 's': 'error', 'o': ohlc}, {'c': 'positive_prices', 's': 'error', 'o': pos}, {'c': 'volume_non_negative', 's': 'error', 'o': neg},
      {'c': 'gap_census', 's': 'warning', 'o': gaps}, {'c': 'zero_volume_bars', 's': 'warning', 'o': zero}, {'c': 'spread_series_informative', 's': 'warning', 'o': 1}, {'c': 'price_quantization', 's': 'warning', 'o': coarse}]) AS i FROM k)
    SELECT symbol, i.c AS "check", i.s AS severity, CAST(i.o AS BIGINT) AS offending, i.o = 0 AS passed FROM u"""
)
def qa_report(spark, d):
    return quality.quality_report(bars(spark, d), 3600, 0.01)


@query(
    S.with_(f" q AS (SELECT *, ts - lag(ts) OVER ({S.W}) AS dt FROM bars)")
    + f"SELECT symbol, CAST(row_number() OVER ({S.W}) AS INTEGER) AS nth, bar_idx, CAST(dt // 3600 - 1 AS BIGINT) AS missing FROM q WHERE dt > 3600 QUALIFY row_number() OVER ({S.W}) <= 20"
)
def gap_census(spark, d):
    return quality.gap_census(bars(spark, d), 3600)


@query(S.with_() + "SELECT symbol, count(*) FILTER (0.01 / greatest(close, 0.01) > 0.01) AS coarse_ticks, min(bar_idx) FILTER (NOT 0.01 / greatest(close, 0.01) > 0.01) AS first_fine_bar FROM bars GROUP BY symbol")
def price_quantization(spark, d):
    return quality.quality_counts(bars(spark, d), 3600, 0.01).select("symbol", "coarse_ticks", "first_fine_bar")


# ---- splits --------------------------------------------------------------------------


def _plan(spark, d) -> splits.Plan:
    """Walk-forward ranges over all bars of the longest series."""
    n = bars(spark, d).agg(F.max("bar_idx")).first()[0] + 1
    return splits.walk_forward(n, splits.SplitConfig(3, n // 10, 2, n // 20, 8, 4, n // 8, n // 5))


@query(S.with_(S.PLAN) + 'SELECT CAST(plan AS INTEGER) AS plan, CAST(inner_fold AS INTEGER) AS "inner", role, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM pl')
def walk_forward_ranges(spark, d):
    return splits.plan_frame(spark, _plan(spark, d))


@query(
    S.with_(S.PLAN)
    + f'SELECT symbol, CAST(plan AS INTEGER) AS plan, CAST(inner_fold AS INTEGER) AS "inner", role, count(*) AS n_bars, {r("avg(close)")} AS mean_close FROM bars JOIN pl ON bar_idx >= start AND bar_idx < stop GROUP BY ALL'
)
def fold_bar_counts(spark, d):
    rows = splits.bars_in_ranges(bars(spark, d), splits.plan_frame(spark, _plan(spark, d)))
    return rounded(rows.groupBy("symbol", "plan", "inner", "role").agg(F.count(F.lit(1)).alias("n_bars"), F.avg("close").alias("mean_close")), "mean_close")


@query(
    S.with_(S.CPCV)
    + """SELECT CAST(split AS INTEGER) AS plan, symbol, count(*) FILTER (inside) AS test_bars, count(*) FILTER (NOT near) AS train_bars FROM (
      SELECT split, symbol, bar_idx, bool_or(bar_idx >= a AND bar_idx < b) AS inside, bool_or(bar_idx >= a - 5 AND bar_idx < b + 3) AS near FROM bars, pl GROUP BY ALL) GROUP BY ALL"""
)
def cpcv_train_counts(spark, d):
    b = bars(spark, d)
    rows = splits.bars_in_ranges(b, splits.combinatorial_ranges(b, 6, 2, 5, 3))
    return rows.groupBy("plan", "symbol").agg(F.count_if(F.col("role") == "test").alias("test_bars"), F.count_if(F.col("role") == "train").alias("train_bars"))


@query(
    S.with_(S.PLAN + ", tr AS (SELECT * FROM pl WHERE role IN ('train', 'inner_train')), te AS (SELECT * FROM pl WHERE role IN ('test', 'validation'))")
    + """SELECT CAST(te.plan AS INTEGER) AS plan, CAST(te.inner_fold AS INTEGER) AS "inner", CAST(te.start - max(tr.stop) AS BIGINT) AS distance FROM tr JOIN te ON tr.plan = te.plan AND tr.inner_fold = te.inner_fold
    WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.plan = te.plan AND x.inner_fold = te.inner_fold AND x.start < te.stop AND x.stop + 8 > te.start) GROUP BY te.plan, te.inner_fold, te.start"""
)
def split_leakage_check(spark, d):
    plan = splits.plan_frame(spark, _plan(spark, d))
    train = plan.where(F.col("role").isin("train", "inner_train")).groupBy("plan", "inner").agg(F.max("stop").alias("until"))
    test = plan.where(F.col("role").isin("test", "validation")).select("plan", "inner", "start")
    clean = test.join(splits.leaks(plan, 8).select("plan", "inner").distinct(), ["plan", "inner"], "left_anti")
    return clean.join(train, ["plan", "inner"]).select("plan", "inner", (F.col("start") - F.col("until")).alias("distance"))


# ---- regimes -------------------------------------------------------------------------

_FINGER = ["atr_pct_median", "atr_pct_iqr_rel", "efficiency_median", "efficiency_p90", "abs_ret_median", "ret_tail_ratio", "gap_over_atr_freq", "ret_autocorr_lag1"]


@query(
    S.with_(S.FEATURES, f" fx AS (SELECT *, CASE WHEN atr > 0 AND pc IS NOT NULL THEN CASE WHEN abs(open - pc) > atr THEN 1.0 ELSE 0.0 END END AS jump, lag(ret) OVER ({S.W}) AS rb FROM ft)")
    + f"""SELECT symbol, count(*) AS n_bars, {r('median(atr_pct)')} AS atr_pct_median, {r('(quantile_cont(atr_pct, 0.75) - quantile_cont(atr_pct, 0.25)) / median(atr_pct)')} AS atr_pct_iqr_rel, {r('median(er)')} AS efficiency_median,
      {r('quantile_cont(er, 0.9)')} AS efficiency_p90, {r('median(abs(ret))')} AS abs_ret_median, {r('quantile_cont(abs(ret), 0.99) / median(abs(ret))')} AS ret_tail_ratio, {r('avg(jump)')} AS gap_over_atr_freq, {r('corr(ret, rb)')} AS ret_autocorr_lag1 FROM fx GROUP BY symbol"""
)
def fingerprint(spark, d):
    return rounded(regimes.fingerprint(bars(spark, d)), *_FINGER)


@query(S.with_(S.FEATURES, S.ROUTER) + f"SELECT symbol, {r('er_threshold')} AS er_threshold, {r('vol_threshold')} AS vol_threshold FROM ro")
def router_fit(spark, d):
    return rounded(regimes.fit_router(bars(spark, d)), "er_threshold", "vol_threshold")


def _raw(spark, d):
    b = bars(spark, d)
    return regimes.raw_regimes(b, regimes.fit_router(b))


@query(S.with_(S.FEATURES, S.ROUTER, S.RAW) + "SELECT symbol, bar_idx, raw FROM raws")
def regime_raw(spark, d):
    return _raw(spark, d)


@query(S.with_(S.FEATURES, S.ROUTER, S.RAW, S.DWELL) + "SELECT symbol, bar_idx, raw, regime FROM dwelt")
def regime_dwell(spark, d):
    return regimes.dwell(_raw(spark, d))


@query(S.with_(S.FEATURES, S.ROUTER, S.RAW, S.DWELL) + "SELECT symbol, regime, count(*) AS bars FROM dwelt WHERE regime > 0 GROUP BY symbol, regime QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, regime) = 1")
def dominant_regime(spark, d):
    return regimes.dominant(regimes.dwell(_raw(spark, d)))


# ---- simulation ----------------------------------------------------------------------

RISK = simulate.Risk(sl_atr=1.0, tp_atr=1.5, risk_per_trade=0.01, max_bars=12, cooldown_bars=2)
COSTS = simulate.Costs(lot_size=1.0, max_lot=1_000_000.0)


def signals(spark, d) -> DataFrame:
    named = {"entry_long": n("cross_above", CLOSE, _sma10), "entry_short": n("cross_below", CLOSE, _sma10), "atr": n("atr", period=14)}
    return evaluate(bars(spark, d), named).withColumn("allow", F.lit(True))


def _trades(spark, d, costs=COSTS) -> DataFrame:
    return simulate.simulate(signals(spark, d), RISK, costs)


@query(S.with_(S.candidates()) + f"SELECT symbol, signal_idx, entry_idx, direction, {r('fill')} AS fill, {r('sl')} AS sl, {r('tp')} AS tp, until_idx FROM ca")
def entry_candidates(spark, d):
    return rounded(simulate.entry_candidates(signals(spark, d), RISK, COSTS), "fill", "sl", "tp").select("symbol", "signal_idx", "entry_idx", "direction", "fill", "sl", "tp", "until_idx")


@query(S.with_(S.candidates()) + f"SELECT symbol, signal_idx, exit_idx, {r('exit_price')} AS exit_price, exit_reason FROM ex")
def exit_scan(spark, d):
    s = signals(spark, d)
    got = simulate.exit_scan(simulate.entry_candidates(s, RISK, COSTS), s, RISK, COSTS)
    return rounded(got, "exit_price").select("symbol", "signal_idx", "exit_idx", "exit_price", "exit_reason")


@query(
    S.with_(S.candidates(), " z AS (SELECT *, 100000.0 * 0.01 / stop AS want FROM ca WHERE stop IS NOT NULL)", " z2 AS (SELECT *, CASE WHEN want * fill > 100000.0 THEN 100000.0 / fill ELSE want END AS q FROM z)")
    + f"SELECT symbol, signal_idx, {r(S._lots('q'))} AS lots, CASE WHEN {S._lots('q')} <= 0 THEN 'below_min_lot' END AS reason FROM z2"
)
def position_sizing(spark, d):
    c = simulate.entry_candidates(signals(spark, d), RISK, COSTS).where("stop is not null")
    lots, reason = simulate.sizing(F.lit(100_000.0), F.col("stop"), F.col("fill"), RISK.risk_per_trade, COSTS)
    return c.select("symbol", "signal_idx", F.round(lots, DIGITS).alias("lots"), reason.alias("reason"))


@query(S.with_(S.fold(), recursive=True) + f"SELECT symbol, signal_idx, entry_idx, exit_idx, CAST(direction AS INTEGER) AS direction, {r('fill')} AS entry_price, {r('exit_price')} AS exit_price, {r('lots')} AS lots, round(costs, 8) AS costs, round(pnl, 8) AS pnl, exit_reason FROM trades")
def trades_greedy(spark, d):
    t = simulate.trades_of(_trades(spark, d))
    # a price of three decimals, lots of two and a rate of three make eight: rounding to fewer would meet ties
    t = rounded(t, "entry_price", "exit_price", "lots").withColumns({c: F.round(c, 8) for c in ("costs", "pnl")})
    return t.select("symbol", "signal_idx", "entry_idx", "exit_idx", "direction", "entry_price", "exit_price", "lots", "costs", "pnl", "exit_reason")


@query(S.with_(S.fold(), recursive=True) + "SELECT symbol, entry_idx AS bar_idx, CAST(direction AS INTEGER) AS direction, skip AS reason FROM fo WHERE skip IS NOT NULL")
def skipped_entries(spark, d):
    return simulate.skipped_of(_trades(spark, d))


def _equity(spark, d) -> tuple[DataFrame, DataFrame]:
    s = signals(spark, d).persist()
    t = simulate.trades_of(simulate.simulate(s, RISK, COSTS)).persist()  # both are read more than once
    return simulate.equity_curve(s, t, COSTS), t


@query(S.with_(S.fold(), S.EQUITY, recursive=True) + f"SELECT symbol, bar_idx, {r('equity')} AS equity FROM eq")
def equity_curve(spark, d):
    return rounded(_equity(spark, d)[0], "equity")


@query(S.with_(S.fold(), S.EQUITY, recursive=True) + f"SELECT symbol, {r('max_drawdown')} AS max_drawdown FROM dd")
def drawdown(spark, d):
    return rounded(simulate.drawdowns(_equity(spark, d)[0]), "max_drawdown")


_METRICS = ["total_return", "max_drawdown", "sharpe_annualized", "profit_factor", "win_rate", "exposure", "total_costs"]


@query(
    S.with_(
        S.fold(),
        S.EQUITY,
        f""" er AS (SELECT symbol, count(*) AS n, arg_min(equity, bar_idx) AS a, arg_max(equity, bar_idx) AS z, avg(x) AS m, stddev_samp(x) AS sd FROM (SELECT *, equity / nullif(lag(equity) OVER ({S.W}), 0) - 1 AS x FROM eq) GROUP BY symbol)""",
        """ ts AS (SELECT symbol, count(*) AS k, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS won, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS lost, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(exit_idx - entry_idx + 1) AS held, sum(costs) AS c FROM trades GROUP BY symbol)""",
        recursive=True,
    )
    + f"""SELECT symbol, coalesce(k, 0) AS n_trades, {r('z / a - 1')} AS total_return, {r('max_drawdown')} AS max_drawdown, {r('CASE WHEN sd > 0 THEN m / sd * sqrt(525600 / 60) END')} AS sharpe_annualized,
      {r('CASE WHEN lost > 0 THEN won / lost END')} AS profit_factor, {r('wr')} AS win_rate, {r('coalesce(held, 0) / n')} AS exposure, {r('coalesce(c, 0.0)')} AS total_costs FROM er JOIN dd USING (symbol) LEFT JOIN ts USING (symbol)"""
)
def backtest_metrics(spark, d):
    return rounded(simulate.metrics(*_equity(spark, d)), *_METRICS)


STRESS = (1.0, 1.5, 2.0, 3.0)


@query(
    " UNION ALL ".join(
        "(" + S.with_(S.fold(2.0 * m), recursive=True) + f"SELECT {m!r} AS multiplier, symbol, count(*) AS n_trades, {r('sum(pnl)')} AS net FROM trades GROUP BY symbol)" for m in map(float, STRESS)
    )
)
def cost_stress(spark, d):
    s = signals(spark, d).persist()
    out = None
    for m in STRESS:
        t = simulate.trades_of(simulate.simulate(s, RISK, simulate.stressed(COSTS, m)))
        part = rounded(t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("pnl").alias("net")), "net").withColumn("multiplier", F.lit(float(m)))
        out = part if out is None else out.unionByName(part)
    return out


# ---- ranking -------------------------------------------------------------------------


def candidates(spark, d) -> DataFrame:
    """Sixty stand-in candidates from `orders`, a fold return for each year."""
    o = table(spark, d, "orders").where("o_custkey is not null and o_totalprice is not null and o_orderdate is not null")
    num = F.pmod("o_custkey", F.lit(60)).cast("int")
    high, low = F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").like("2%"), F.col("o_orderpriority").like("5%")
    years = o.groupBy(num.alias("num"), F.year("o_orderdate").alias("y")).agg(
        F.round(F.avg("o_totalprice") / 250000 - 0.5, 4).alias("r"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(high, F.col("o_totalprice")).otherwise(0.0)).alias("won"),
        F.sum(F.when(low, F.col("o_totalprice")).otherwise(0.0)).alias("lost"),
    )
    k = F.col("num")
    return (
        years.groupBy("num")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("y", "r"))), lambda x: x["r"]).alias("fold_returns"),
            F.sum("n").alias("n_trades_total"),
            F.round(F.max("r") - F.min("r"), 4).alias("max_drawdown"),
            F.when(F.sum("lost") > 0, F.round(F.sum("won") / F.sum("lost"), 4)).alias("profit_factor"),
        )
        .select(
            F.concat(F.lit("c"), k.cast("string")).alias("candidate"),
            "fold_returns",
            "n_trades_total",
            "max_drawdown",
            "profit_factor",
            ((k * 7) % 150).alias("complexity"),
            F.round(F.col("n_trades_total") % 40 / 200.0, 4).alias("trade_frequency"),
            ((k * 13) % 70).cast("double").alias("avg_holding_bars"),
            F.round((k % 11) / 10.0, 4).alias("long_share"),
            F.round((k % 9) / 8.0, 4).alias("win_rate"),
        )
    )


def scored(spark, d) -> DataFrame:
    out = ranking.objectives(candidates(spark, d))
    return rounded(out, "median_fold_return", "neg_fold_dispersion", "total_violation")


_CAND = "WITH " + S.CANDIDATES
_CAND_R = "WITH RECURSIVE " + S.CANDIDATES + S.FRONTS
_OBJ = ", ".join(ranking.OBJECTIVES)


@query(_CAND + f" SELECT candidate, {_OBJ}, {', '.join(r(v) + ' AS ' + v for v in ranking.VIOLATIONS)}, total_violation, total_violation = 0 AS feasible FROM vio")
def objectives_violations(spark, d):
    return rounded(scored(spark, d), *ranking.VIOLATIONS).select("candidate", *ranking.OBJECTIVES, *ranking.VIOLATIONS, "total_violation", "feasible")


@query(
    _CAND
    + """ SELECT candidate, array_to_string(list_filter([CASE WHEN n_trades_total = 0 THEN 'NO_SIGNAL' WHEN v_trades > 0 THEN 'INSUFFICIENT_TRADES' END, CASE WHEN trade_frequency > 0.15 THEN 'OVERFIRE' END, CASE WHEN v_dispersion > 0 THEN 'FOLD_INSTABILITY' END,
      CASE WHEN v_drawdown > 0 THEN 'STOP_GAP_RISK' END, CASE WHEN n_trades_total > 0 AND (v_profit_factor > 0 OR v_median > 0 OR (med <= 0 AND pf < 1)) THEN 'NO_EDGE_UNDER_REALISTIC_COSTS' END, CASE WHEN v_complexity > 0 THEN 'EXCESS_COMPLEXITY' END], lambda x: x IS NOT NULL), ',') AS labels FROM vio"""
)
def failure_labels(spark, d):
    return ranking.failure_labels(ranking.objectives(candidates(spark, d))).select("candidate", F.array_join("labels", ",").alias("labels"))


@query(_CAND + f" SELECT candidate, {_OBJ} FROM vio b WHERE NOT EXISTS (SELECT 1 FROM vio a WHERE {S.BEATS})")
def pareto_front0(spark, d):
    return ranking.pareto_front(scored(spark, d)).select("candidate", *ranking.OBJECTIVES)


@query(_CAND_R + " SELECT candidate, front FROM ranked")
def nsga_fronts(spark, d):
    return ranking.fronts(scored(spark, d)).select("candidate", "front")


@query(_CAND_R + S.crowd() + f" SELECT candidate, front, {r('crowding')} AS crowding FROM cro")
def crowding(spark, d):
    return rounded(ranking.crowding(ranking.fronts(scored(spark, d))), "crowding").select("candidate", "front", "crowding")


@query(_CAND_R + S.crowd() + ", c6 AS (SELECT *, round(crowding, 6) AS c FROM cro) SELECT candidate, feasible, CAST(row_number() OVER (ORDER BY feasible DESC, CASE WHEN feasible THEN front ELSE 0 END, total_violation, c DESC, candidate) AS INTEGER) AS rank FROM c6")
def nsga_rank(spark, d):
    crowded = rounded(ranking.crowding(ranking.fronts(scored(spark, d))), "crowding")
    return ranking.rank_candidates(crowded).select("candidate", "feasible", "rank")


_CELLS = ", ".join(f"CAST(floor((least(greatest({c}, {lo!r}), {hi!r} - 1e-12) - {lo!r}) / ({hi!r} - {lo!r}) * {b}) AS INTEGER) AS cell_{c}" for c, lo, hi, b in ranking.AXES)


@query(
    _CAND
    + f", cl AS (SELECT *, {_CELLS} FROM vio) SELECT {', '.join('cell_' + a[0] for a in ranking.AXES)}, arg_min(candidate, row(CASE WHEN total_violation = 0 THEN 0 ELSE 1 END, total_violation, -median_fold_return, candidate)) AS elite, count(*) AS tried FROM cl GROUP BY ALL"
)
def map_elites_cells(spark, d):
    return ranking.archive(scored(spark, d))


@query(_CAND + f", cl AS (SELECT {_CELLS} FROM vio) SELECT count(*) AS cells, {r('count(*) / 480')} AS coverage FROM (SELECT DISTINCT * FROM cl)")
def archive_coverage(spark, d):
    return rounded(ranking.coverage(ranking.archive(scored(spark, d))), "coverage")


@query(
    _CAND
    + """, p AS (SELECT median_fold_return AS x, neg_max_drawdown AS y FROM vio WHERE median_fold_return > -1 AND neg_max_drawdown > -1),
    q AS (SELECT x, y, coalesce(max(y) OVER (ORDER BY x DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS best FROM p)"""
    + f" SELECT {r('coalesce(sum(greatest(0.0, (x + 1) * (y - best))), 0.0)')} AS hypervolume FROM q"
)
def hypervolume_2d(spark, d):
    return rounded(ranking.hypervolume(scored(spark, d), "median_fold_return", "neg_max_drawdown"), "hypervolume")


# ---- memory --------------------------------------------------------------------------


def evaluated(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id is not null")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("context"),
        F.concat(F.lit("op"), F.pmod("user_id", F.lit(7)).cast("string")).alias("operator"),
        F.when(F.col("event_id") % 10 != 0, F.col("value") > 100).alias("reward"),
        F.filter(F.array(F.when(k % 2 == 0, "OVERFIRE"), F.when(k % 3 == 0, "NO_SIGNAL"), F.when(k % 5 == 0, "STOP_GAP_RISK")), lambda x: x.isNotNull()).alias("failure_labels"),
    )


@query(
    f"""SELECT event_type AS context, 'op' || CAST(user_id % 7 AS VARCHAR) AS operator, count(*) FILTER (value > 100) AS successes, count(*) AS trials, {r('(count(*) FILTER (value > 100) + 1) / (count(*) + 2)')} AS posterior_mean
    FROM events WHERE event_id IS NOT NULL AND event_id % 10 <> 0 AND value IS NOT NULL GROUP BY ALL"""
)
def operator_outcomes(spark, d):
    return rounded(memory.operator_outcomes(evaluated(spark, d)), "posterior_mean")


_LABELS = "WITH k AS (SELECT event_type AS context, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id IS NOT NULL), l AS (SELECT context, unnest(list_filter([CASE WHEN k % 2 = 0 THEN 'OVERFIRE' END, CASE WHEN k % 3 = 0 THEN 'NO_SIGNAL' END, CASE WHEN k % 5 = 0 THEN 'STOP_GAP_RISK' END], lambda x: x IS NOT NULL)) AS label FROM k) "


@query(_LABELS + "SELECT context, label, count(*) AS n FROM l GROUP BY ALL")
def failure_label_counts(spark, d):
    return memory.failure_label_counts(evaluated(spark, d))


@query(_LABELS + "SELECT context, label, count(*) AS n, CAST(row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, label) AS INTEGER) AS nth FROM l GROUP BY context, label QUALIFY row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, label) <= 2")
def retrieval_top_failures(spark, d):
    return memory.top_failure_labels(memory.failure_label_counts(evaluated(spark, d)), 2)


@query(
    """WITH l AS (SELECT s_suppkey AS lesson_id, s_suppkey % 5 <> 0 AS active, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey - 1 END AS supersedes, round(s_acctbal / 10000, 4) AS confidence, s_nationkey AS evidence_count, unnest(['ctx' || CAST(s_nationkey % 3 AS VARCHAR), 'all']) AS context FROM supplier)
    SELECT lesson_id, context, confidence, evidence_count, CAST(row_number() OVER (PARTITION BY context ORDER BY confidence DESC, evidence_count DESC, lesson_id) AS INTEGER) AS nth FROM l
    WHERE active AND lesson_id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY context ORDER BY confidence DESC, evidence_count DESC, lesson_id) <= 5"""
)
def lesson_active_topk(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    lessons = s.select(
        k.alias("lesson_id"),
        F.array(F.concat(F.lit("ctx"), (F.col("s_nationkey") % 3).cast("string")), F.lit("all")).alias("contexts"),
        F.round(F.col("s_acctbal") / 10000, 4).alias("confidence"),
        F.col("s_nationkey").alias("evidence_count"),
        (k % 5 != 0).alias("active"),
        F.when(k % 4 == 0, k - 1).alias("supersedes"),
    )
    return memory.active_lessons(lessons)


@query("SELECT event_id AS node, event_id - event_id % 32 AS root FROM events WHERE event_id IS NOT NULL")
def lineage_root(spark, d):
    links = table(spark, d, "events").where("event_id is not null").select(F.col("event_id").alias("node"), F.when(F.col("event_id") % 32 != 0, F.col("event_id") - 1).alias("parent"))
    return memory.lineage_roots(links)


# ---- statistics ----------------------------------------------------------------------


def battery(spark, d) -> DataFrame:
    """Returns of the mean value of each event type over all six-hour steps."""
    e = table(spark, d, "events").where("ts is not null and value is not null")
    b = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 21600)
    six = e.groupBy(F.col("event_type").alias("cand"), b.alias("b")).agg(F.avg("value").alias("m"))
    before = F.lag("m").over(W.partitionBy("cand").orderBy("b"))
    ret = six.withColumn("ret", F.round(F.col("m") / F.nullif(before, F.lit(0.0)) - 1, DIGITS)).where("ret is not null")
    steps = ordinals(ret.select("b").distinct(), ["b"], "t", 0)
    return ret.join(steps, "b").select("t", "cand", "ret")


_BAT = "WITH " + S.BATTERY


@query(
    _BAT
    + f""", m AS (SELECT cand, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM battery GROUP BY cand)
    SELECT cand, n, {r('mean')} AS mean, {r('sd')} AS sd, {r('mean / sd')} AS sharpe, {r('avg(((ret - mean) / sd) ** 3)')} AS skew, {r('avg(((ret - mean) / sd) ** 4)')} AS kurt FROM battery JOIN m USING (cand) GROUP BY cand, n, mean, sd"""
)
def sharpe_moments(spark, d):
    return rounded(stats.sharpe_moments(battery(spark, d)), "mean", "sd", "sharpe", "skew", "kurt")


@query(
    _BAT
    + f""", c AS (SELECT a.cand AS x, b.cand AS y, corr(a.ret, b.ret) AS r FROM battery a JOIN battery b USING (t) GROUP BY ALL)
    SELECT count(DISTINCT x) AS n_candidates, {r('count(DISTINCT x) * count(DISTINCT x) / sum(r * r)')} AS n_effective FROM c"""
)
def effective_trials(spark, d):
    return rounded(stats.effective_trials(battery(spark, d)), "n_effective")


_CSCV = (
    _BAT
    + f""", g AS (SELECT t, ntile(6) OVER (ORDER BY t) AS grp FROM (SELECT DISTINCT t FROM battery)), co AS (SELECT * FROM {S.combos(6)}),
    pf AS (SELECT combo, inside, cand, avg(ret) / stddev_samp(ret) AS p FROM battery JOIN g USING (t) JOIN co USING (grp) GROUP BY ALL),
    bo AS (SELECT i.combo, i.cand, i.p AS ip, o.p AS op FROM pf i JOIN pf o ON i.combo = o.combo AND i.cand = o.cand AND i.inside AND NOT o.inside),
    be AS (SELECT combo, cand AS best, op AS bop FROM bo QUALIFY row_number() OVER (PARTITION BY combo ORDER BY ip DESC, cand) = 1),
    om AS (SELECT combo, any_value(best) AS best, (count(*) FILTER (op < bop) + 0.5 * (count(*) FILTER (op = bop) - 1) + 1) / (count(*) + 1) AS omega FROM bo JOIN be USING (combo) GROUP BY combo) """
)


@query(_CSCV + f"SELECT CAST(combo AS INTEGER) AS combo, best, {r('omega')} AS omega, {r('ln(omega / (1 - omega))')} AS logit FROM om")
def pbo_combos(spark, d):
    return rounded(stats.cscv(battery(spark, d), 6), "omega", "logit")


@query(_CSCV + f"SELECT count(*) AS n_combos, {r('avg(CASE WHEN ln(omega / (1 - omega)) <= 0 THEN 1.0 ELSE 0.0 END)')} AS pbo, {r('median(ln(omega / (1 - omega)))')} AS median_logit FROM om")
def pbo_cscv(spark, d):
    return rounded(stats.overfitting_probability(stats.cscv(battery(spark, d), 6)), "pbo", "median_logit")


def _resampling(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """The battery, the block starts of twenty bootstrap series by a multiplicative rule (which SQL can follow), and the number of steps."""
    returns = battery(spark, d)
    n = returns.agg(F.max("t")).first()[0] + 1
    starts = spark.range(20).select(F.col("id").cast("int").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit((n + 9) // 10 - 1))).alias("block_no"))
    start = (F.col("sample").cast("long") * 1000003 + F.col("block_no") + 1) * F.lit(2654435761) % F.lit(4294967296) % n
    return returns, starts.withColumn("start", start), n


@query(_BAT + S.RESAMPLED + f" SELECT CAST(sample AS INTEGER) AS sample, cand, {r('avg(ret)')} AS mean FROM boot GROUP BY ALL")
def block_bootstrap_means(spark, d):
    returns, starts, n = _resampling(spark, d)
    boot = stats.resampled(returns, starts, n, 10)
    return rounded(boot.groupBy("sample", "cand").agg(F.avg("ret").alias("mean")), "mean")


@query(
    _BAT
    + S.RESAMPLED
    + f""", m AS (SELECT cand, avg(ret) AS mu FROM battery GROUP BY cand), o AS (SELECT max(mu) * sqrt((SELECT n FROM len)) AS ob FROM m),
    s AS (SELECT sample, max(x - mu) * sqrt((SELECT n FROM len)) AS st FROM (SELECT sample, cand, avg(ret) AS x FROM boot GROUP BY ALL) JOIN m USING (cand) GROUP BY sample)
    SELECT {r('any_value(ob)')} AS observed, {r('(count(*) FILTER (st >= ob) + 1) / (count(*) + 1)')} AS p_value FROM s, o"""
)
def reality_check(spark, d):
    returns, starts, n = _resampling(spark, d)
    return rounded(stats.reality_check(returns, starts, n, 10), "observed", "p_value")


@query(
    _BAT
    + S.RESAMPLED
    + f", q AS (SELECT sample, avg(ret) / stddev_samp(ret) AS s FROM boot GROUP BY sample) SELECT {r('quantile_cont(s, 0.05)')} AS p05, {r('quantile_cont(s, 0.5)')} AS p50, {r('quantile_cont(s, 0.95)')} AS p95 FROM q"
)
def sharpe_confidence(spark, d):
    returns, starts, n = _resampling(spark, d)
    return rounded(stats.sharpe_confidence(stats.resampled(returns, starts, n, 10)), "p05", "p50", "p95")


@query(
    S.with_(S.fold(), recursive=True)
    + f""", w AS (SELECT symbol, pnl, greatest(pnl, 0.0) / nullif(sum(greatest(pnl, 0.0)) OVER (PARTITION BY symbol), 0) AS s, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC) AS k FROM trades)
    SELECT symbol, {r('coalesce(sum(s) FILTER (k <= 1), 0.0)')} AS top1_share, {r('coalesce(sum(s) FILTER (k <= 3), 0.0)')} AS top3_share, {r('coalesce(sum(s * s), 0.0)')} AS hhi, {r('sum(pnl)')} AS net FROM w GROUP BY symbol"""
)
def return_concentration(spark, d):
    return rounded(stats.return_concentration(simulate.trades_of(_trades(spark, d))), "top1_share", "top3_share", "hhi", "net")


# ---- parity --------------------------------------------------------------------------


@query(
    S.with_(S.SIGNALS)
    + """, th AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 97 = 0 THEN NOT entry_long ELSE entry_long END AS entry_long, entry_short, CASE WHEN bar_idx % 101 = 0 THEN atr + 1 ELSE atr END AS atr FROM sg WHERE bar_idx % 211 <> 5),
    j AS (SELECT s.symbol, s.bar_idx, t.symbol IS NULL AS gone, s.entry_long AS a, t.entry_long AS b, s.atr AS x, t.atr AS y FROM sg s LEFT JOIN th t ON s.symbol = t.symbol AND s.bar_idx = t.bar_idx)
    SELECT symbol, bar_idx, 'missing' AS field, CAST(NULL AS VARCHAR) AS ours, CAST(NULL AS VARCHAR) AS theirs FROM j WHERE gone
    UNION ALL SELECT symbol, bar_idx, 'entry_long', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM j WHERE NOT gone AND a <> b
    UNION ALL SELECT symbol, bar_idx, 'atr', CAST(round(x, 6) AS VARCHAR), CAST(round(y, 6) AS VARCHAR) FROM j WHERE NOT gone AND abs(x - y) > 1e-6"""
)
def signal_parity_diff(spark, d):
    ours = signals(spark, d).select("symbol", "bar_idx", "entry_long", "entry_short", "atr")
    k = F.col("bar_idx")
    theirs = ours.where(k % 211 != 5).withColumns({"entry_long": F.when(k % 97 == 0, ~F.col("entry_long")).otherwise(F.col("entry_long")), "atr": F.when(k % 101 == 0, F.col("atr") + 1).otherwise(F.col("atr"))})
    return parity.signal_differences(ours, theirs, ["symbol", "bar_idx"], ["entry_long", "entry_short"], ["atr"])


@query(
    S.with_(S.fold(), recursive=True)
    + f""", o AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) AS nth, fill, exit_price FROM trades),
    t AS (SELECT symbol, nth, fill, CASE WHEN nth % 5 = 0 THEN exit_price + 1 ELSE exit_price END AS exit_price FROM o)
    SELECT symbol, CAST(nth AS INTEGER) AS nth, 'exit_price' AS field, {r('o.exit_price')} AS ours, {r('t.exit_price')} AS theirs FROM o JOIN t USING (symbol, nth) WHERE abs(o.exit_price - t.exit_price) > 1e-6
    UNION ALL SELECT symbol, 0, 'count', CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM (SELECT symbol, count(*) AS a FROM o GROUP BY symbol) JOIN (SELECT symbol, count(*) AS b FROM t GROUP BY symbol) USING (symbol) WHERE a <> b"""
)
def trade_parity_diff(spark, d):
    ours = simulate.trades_of(_trades(spark, d)).select("symbol", "entry_idx", "entry_price", "exit_price")
    nth = F.row_number().over(W.partitionBy("symbol").orderBy("entry_idx"))
    theirs = ours.withColumn("_n", nth).withColumn("exit_price", F.when(F.col("_n") % 5 == 0, F.col("exit_price") + 1).otherwise(F.col("exit_price"))).drop("_n")
    return rounded(parity.trade_differences(ours, theirs, "symbol", "entry_idx", ["entry_price", "exit_price"]), "ours", "theirs")


# ---- streaming -----------------------------------------------------------------------


@query(S.with_() + "SELECT symbol, count(*) AS n_bars, CAST(0 AS BIGINT) AS n_different FROM bars GROUP BY symbol")
def stream_dsl_parity(spark, d):
    """Bars on which the bar-at-a-time evaluator and the batch plan differ."""
    named = {"macd": MACD, "z": n("zscore", CLOSE, period=20), "rsi": n("rsi", CLOSE, period=14), "atr": n("atr", period=14), "x": n("cross_above", CLOSE, _sma10)}
    b = bars(spark, d)
    batch = evaluate(b, named, ["symbol", "bar_idx"])
    live = incremental.evaluate_sorted(b, named)
    both = batch.join(live.withColumnsRenamed({k: f"l_{k}" for k in named}), ["symbol", "bar_idx"])
    differs = F.lit(False)
    for k in named:
        a, c = F.col(k).cast("double"), F.col(f"l_{k}").cast("double")
        differs |= F.coalesce(F.abs(a - c) > 1e-9 * (1 + F.abs(a)), a.isNull() != c.isNull())
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(differs).alias("n_different"))


@query()
def tick_engine(spark, d):
    """Trades of the tick engine on the raw events as quotes, for the hourly signals."""
    e = table(spark, d, "events").where("ts is not null and value is not null")
    quotes = e.select(F.col("event_type").alias("symbol"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("double").alias("ts"), "event_id", (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"))
    return rounded(ticks.run(quotes, signals(spark, d), RISK, COSTS, 3600), "entry_price", "exit_price", "lots", "pnl")
