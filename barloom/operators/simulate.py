"""The bar simulator: signals to orders, trades and equity.

Where and how a trade ends depends on prices alone, so all possible trades are
scanned at once (an interval join of bounded width); only which of them are
taken, and their size, depends on what came before, and that is one fold over
the few candidates of a run; the equity of every bar is a join back.

A run is one value of `symbol`: a series, or a series and a scenario.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import MetadataError, PolicyError
from barloom.sources.bars import series

FUNDING_MODES = ("not_applicable_spot", "points_per_day_from_spec")
MINUTES_PER_YEAR = 525_600


@dataclass(frozen=True)
class Risk:
    sl_atr: float = 2.0
    tp_atr: float = 3.0
    risk_per_trade: float = 0.01
    max_bars: int = 24
    cooldown_bars: int = 0
    atr_period: int = 14

    def __post_init__(self) -> None:
        if self.sl_atr <= 0 or self.tp_atr <= 0 or not 0 < self.risk_per_trade <= 0.1 or self.max_bars < 1 or self.cooldown_bars < 0 or self.atr_period < 1:
            raise PolicyError("risk block out of bounds", risk=self)


@dataclass(frozen=True)
class Costs:
    """Execution costs, all explicit; `spread_points` None: the bars' own column."""

    tick_size: float = 0.01
    lot_size: float = 1000.0
    min_lot: float = 0.01
    max_lot: float = 1000.0
    lot_step: float = 0.01
    spread_points: float | None = 2.0
    slippage_points: float = 0.0
    commission_pct: float = 0.001
    funding_long: float = 0.0
    funding_short: float = 0.0
    min_notional: float = 0.0
    max_leverage: float = 1.0
    timeframe_minutes: int = 60


def resolve_costs(spec: dict, has_spread: bool, assumptions: dict) -> Costs:
    """Costs from contract metadata and explicit assumptions; anything unknown raises rather than being invented."""
    spread: float | None
    if spec.get("spread_source") == "series" and has_spread:
        spread = None
    else:
        spread = assumptions.get("assumed_spread_points")
        if spread is None or spread <= 0:
            raise MetadataError("no trusted spread and no positive assumption", symbol=spec.get("symbol"))
    commission = assumptions.get("commission_pct_notional")
    if commission is None or commission < 0:
        raise MetadataError("commission must be stated")
    mode = assumptions.get("funding_mode")
    if mode not in FUNDING_MODES:
        raise MetadataError("funding mode must be stated", mode=mode)
    funding = (0.0, 0.0)
    if mode == "points_per_day_from_spec":
        funding = (spec.get("swap_long"), spec.get("swap_short"))
        if None in funding:
            raise MetadataError("swap rates unknown", symbol=spec.get("symbol"))
    notional = spec.get("min_notional") if spec.get("min_notional") is not None else assumptions.get("min_notional")
    if notional is None:
        raise MetadataError("least notional unknown", symbol=spec.get("symbol"))
    own = {k: spec[k] for k in ("tick_size", "lot_size", "min_lot", "max_lot", "lot_step")}
    return Costs(
        **own,
        spread_points=spread,
        slippage_points=float(assumptions.get("slippage_points", 0.0)),
        commission_pct=float(commission),
        funding_long=float(funding[0]),
        funding_short=float(funding[1]),
        min_notional=float(notional),
        max_leverage=float(assumptions.get("max_leverage", 1.0)),
    )


def stressed(costs: Costs, multiplier: float) -> Costs:
    if costs.spread_points is None:
        raise MetadataError("stress needs a stated spread")
    return replace(costs, spread_points=costs.spread_points * multiplier, slippage_points=costs.slippage_points * multiplier)


def round_lot(lots: Column, c: Costs) -> Column:
    """Down to the grid above the least lot; 0 below it."""
    grid = F.round(F.floor((lots - c.min_lot) / c.lot_step + 1e-9) * c.lot_step + c.min_lot, 12)
    return F.when(lots < c.min_lot, 0.0).otherwise(F.least(grid, F.lit(c.max_lot)))


def sizing(equity: Column, stop: Column, price: Column, risk_per_trade: Column | float, c: Costs) -> tuple[Column, Column]:
    """(lots, reason not to trade or null)."""
    want = equity * risk_per_trade / stop
    most = equity * c.max_leverage
    quantity = F.when(want * price > most, most / price).otherwise(want)
    lots = round_lot(quantity / c.lot_size, c)
    reason = F.when(stop.isNull() | (stop <= 0), "invalid_stop_distance").when(lots <= 0, "below_min_lot").when(lots * c.lot_size * price < c.min_notional, "below_min_notional")
    return F.when(reason.isNull(), lots).otherwise(0.0), reason


def _half_spread(c: Costs) -> Column:
    points = F.col("spread_points") if c.spread_points is None else F.lit(float(c.spread_points))
    return points * c.tick_size / 2


def risk_of(df: DataFrame, risk: Risk | None):
    """How a risk parameter is read: from the struct column `risk` where runs differ in it, else a literal."""
    if "risk" in df.columns:
        return lambda name: F.col("risk")[name]
    if risk is None:
        raise PolicyError("neither a risk block nor a column of them")
    return lambda name: F.lit(getattr(risk, name))


def entry_candidates(signals: DataFrame, risk: Risk | None, costs: Costs) -> DataFrame:
    """Every bar whose signal could be traded, with the fill on the next bar's open, stop and target.

    `signals`: bars with entry_long, entry_short, allow (never null) and atr,
    and `risk` (a struct of the block's fields) if it is not the same for all.
    """
    own = risk_of(signals, risk)
    w = series()
    slip = costs.slippage_points * costs.tick_size
    rows = signals.withColumns({"_hs": _half_spread(costs), "_last": F.max("bar_idx").over(W.partitionBy("symbol"))})
    rows = rows.withColumns({"_open": F.lead("open").over(w), "_hs_next": F.lead("_hs").over(w)})
    rows = rows.where(F.col("allow") & (F.col("entry_long") != F.col("entry_short")) & (F.col("bar_idx") < F.col("_last")))
    side = F.when(F.col("entry_long"), 1).otherwise(-1)
    ok = F.col("atr").isNotNull() & ~F.isnan("atr") & (F.col("atr") > 0) & (F.col("atr") < float("inf"))
    rows = rows.withColumns({"direction": side, "fill": F.col("_open") + side * (F.col("_hs_next") + slip), "stop": F.when(ok, own("sl_atr") * F.col("atr"))})
    return rows.select(
        "symbol",
        F.col("bar_idx").alias("signal_idx"),
        (F.col("bar_idx") + 1).alias("entry_idx"),
        F.col("direction").cast("int").alias("direction"),
        "fill",
        "stop",
        (F.col("fill") - F.col("direction") * F.col("stop")).alias("sl"),
        F.when(ok, F.col("fill") + F.col("direction") * own("tp_atr") * F.col("atr")).alias("tp"),
        F.least(F.col("bar_idx") + 1 + own("max_bars"), "_last").alias("until_idx"),
        F.col("_last").alias("last_idx"),
        *(["risk"] if "risk" in signals.columns else []),
    )


def exit_scan(candidates: DataFrame, signals: DataFrame, risk: Risk | None, costs: Costs, block: int = 256) -> DataFrame:
    """Adds exit_idx, exit_price, exit_reason to every candidate with a stop.

    The interval join is made on blocks of `block` bars, which every candidate
    meets a few of, so it is a hash or merge join whatever the length of a series.
    """
    slip = costs.slippage_points * costs.tick_size
    bars = signals.select("symbol", "bar_idx", "open", "high", "low", "close", _half_spread(costs).alias("hs"), F.floor(F.col("bar_idx") / block).alias("block"))
    able = candidates.where("stop is not null")
    asked = able.withColumn("block", F.explode(F.sequence(F.floor(F.col("entry_idx") / block), F.floor(F.col("until_idx") / block))))
    both = asked.join(bars, ["symbol", "block"]).where((F.col("bar_idx") >= F.col("entry_idx")) & (F.col("bar_idx") <= F.col("until_idx")))
    d = F.col("direction")
    quote = {k: F.col(k) - d * F.col("hs") for k in ("open", "high", "low", "close")}
    worst = F.when(d > 0, quote["low"]).otherwise(quote["high"])
    best = F.when(d > 0, quote["high"]).otherwise(quote["low"])
    sl_hit, tp_hit = d * worst <= d * F.col("sl"), d * best >= d * F.col("tp")
    timed = F.col("bar_idx") - F.col("entry_idx") >= risk_of(candidates, risk)("max_bars")
    reason = F.when(sl_hit, "sl").when(tp_hit, "tp").when(timed, "max_bars").when(F.col("bar_idx") == F.col("last_idx"), "end_of_data")
    # a gap through the level fills at the open
    at_sl = d * F.least(d * quote["open"], d * F.col("sl"))
    at_tp = F.when(d * quote["open"] >= d * F.col("tp"), quote["open"]).otherwise(F.col("tp"))
    price = F.when(sl_hit, at_sl).when(tp_hit, at_tp).otherwise(quote["close"]) - d * slip
    hits = both.withColumns({"reason": reason, "price": price}).where("reason is not null")
    keys = ["symbol", "signal_idx"]
    first = hits.groupBy(*keys).agg(F.min_by(F.struct(F.col("bar_idx").alias("exit_idx"), F.col("price").alias("exit_price"), F.col("reason").alias("exit_reason")), "bar_idx").alias("x"))
    return able.join(first, keys).select(*able.columns, "x.*")


_STATE = "struct<cash:double,busy:bigint,out:array<struct<signal_idx:bigint,entry_idx:bigint,exit_idx:bigint,direction:int,entry_price:double,exit_price:double,sl:double,tp:double,lots:double,qty:double,cash_before:double,entry_cost:double,funding_bar:double,costs:double,pnl:double,exit_reason:string,skip_reason:string>>>"


def fold_trades(candidates: DataFrame, scanned: DataFrame, risk: Risk | None, costs: Costs, initial_equity: float) -> DataFrame:
    """Takes candidates of each run in order: what was taken (skip_reason null) and what was read but skipped.

    One aggregate over the candidates of a run, inside the JVM; a run's
    candidates are at most its bars, and only they are held.
    """
    if initial_equity <= 0:
        raise PolicyError("initial equity must be positive", value=initial_equity)
    extra = [c for c in ("exit_idx", "exit_price", "exit_reason")]
    rows = candidates.join(scanned.select("symbol", "signal_idx", *extra), ["symbol", "signal_idx"], "left")
    item = F.struct("signal_idx", "entry_idx", "direction", "fill", "stop", "sl", "tp", *extra, *(["risk"] if "risk" in candidates.columns else []))
    own = (lambda x, name: x["risk"][name]) if "risk" in candidates.columns else (lambda x, name: F.lit(getattr(risk, name)))
    grouped = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("items"))
    bar_days = costs.timeframe_minutes / 1440.0

    def step(state: Column, x: Column) -> Column:
        cash = state["cash"]
        lots, reason = sizing(cash, x["stop"], x["fill"], own(x, "risk_per_trade"), costs)
        reason = F.when(x["stop"].isNull(), "atr_invalid").otherwise(reason)
        qty = lots * costs.lot_size
        entry_cost = qty * x["fill"] * costs.commission_pct
        points = F.when(x["direction"] > 0, costs.funding_long).otherwise(costs.funding_short)
        funding = points * costs.tick_size * qty * bar_days
        held = (x["exit_idx"] - x["entry_idx"] + 1).cast("double")
        exit_cost = F.abs(x["exit_price"]) * qty * costs.commission_pct
        paid = entry_cost + funding * held + exit_cost
        gross = (x["exit_price"] - x["fill"]) * qty * x["direction"]
        row = F.struct(
            x["signal_idx"].alias("signal_idx"), x["entry_idx"].alias("entry_idx"), x["exit_idx"].alias("exit_idx"), x["direction"].alias("direction"), x["fill"].alias("entry_price"),
            x["exit_price"].alias("exit_price"), x["sl"].alias("sl"), x["tp"].alias("tp"), lots.alias("lots"), qty.alias("qty"), cash.alias("cash_before"), entry_cost.alias("entry_cost"),
            funding.alias("funding_bar"), paid.alias("costs"), (gross - paid).alias("pnl"), x["exit_reason"].alias("exit_reason"), reason.alias("skip_reason"),
        )
        taken = F.struct((cash + gross - paid).alias("cash"), (x["exit_idx"] + own(x, "cooldown_bars")).cast("long").alias("busy"), F.concat(state["out"], F.array(row)).alias("out")).cast(_STATE)
        skipped = F.struct(cash.alias("cash"), state["busy"].alias("busy"), F.concat(state["out"], F.array(row)).alias("out")).cast(_STATE)
        return F.when(x["signal_idx"] < state["busy"], state).when(reason.isNotNull(), skipped).otherwise(taken)

    start = F.struct(F.lit(float(initial_equity)).alias("cash"), F.lit(-1).cast("long").alias("busy"), F.array().alias("out")).cast(_STATE)
    done = grouped.select("symbol", F.aggregate("items", start, step, lambda s: s["out"]).alias("out"))
    return done.select("symbol", F.explode("out").alias("t")).select("symbol", "t.*")


def simulate(signals: DataFrame, risk: Risk | None, costs: Costs, initial_equity: float = 100_000.0) -> DataFrame:
    """All trades and skipped entries of every run."""
    candidates = entry_candidates(signals, risk, costs)
    return fold_trades(candidates, exit_scan(candidates, signals, risk, costs), risk, costs, initial_equity)


def trades_of(simulated: DataFrame) -> DataFrame:
    return simulated.where("skip_reason is null").drop("skip_reason")


def skipped_of(simulated: DataFrame) -> DataFrame:
    return simulated.where("skip_reason is not null").select("symbol", F.col("entry_idx").alias("bar_idx"), "direction", F.col("skip_reason").alias("reason"))


def equity_curve(signals: DataFrame, trades: DataFrame, costs: Costs, initial_equity: float = 100_000.0) -> DataFrame:
    """symbol, bar_idx, equity marked at the close of every bar."""
    w = series()
    bars = signals.select("symbol", "bar_idx", "close", _half_spread(costs).alias("_hs"))
    at_entry = trades.select("symbol", F.col("entry_idx").alias("bar_idx"), F.struct("entry_idx", "exit_idx", "direction", "entry_price", "qty", "cash_before", "entry_cost", "funding_bar", "pnl").alias("_t"))
    rows = bars.join(at_entry, ["symbol", "bar_idx"], "left")
    # trades do not overlap: the latest one that began tells all of a bar
    rows = rows.withColumn("_t", F.last("_t", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    t = F.col("_t")
    held = (F.col("bar_idx") - t["entry_idx"] + 1).cast("double")
    mark = F.col("close") - t["direction"] * F.col("_hs")
    during = t["cash_before"] - t["entry_cost"] - t["funding_bar"] * held + (mark - t["entry_price"]) * t["qty"] * t["direction"]
    equity = F.when(t.isNull(), F.lit(float(initial_equity))).when(F.col("bar_idx") < t["exit_idx"], during).otherwise(t["cash_before"] + t["pnl"])
    return rows.select("symbol", "bar_idx", equity.alias("equity"))


def drawdowns(equity: DataFrame) -> DataFrame:
    """symbol, max_drawdown as a fraction of the running peak."""
    peak = F.max("equity").over(series().rowsBetween(W.unboundedPreceding, 0))
    rows = equity.withColumn("_peak", peak)
    return rows.groupBy("symbol").agg(F.max(F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak")).otherwise(0.0)).alias("max_drawdown"))


def metrics(equity: DataFrame, trades: DataFrame, timeframe_minutes: int = 60) -> DataFrame:
    """One row for each run: returns, drawdown, Sharpe ratio, profit factor, win rate, exposure, costs."""
    rows = equity.withColumn("_ret", F.when(F.lag("equity").over(series()) != 0, F.col("equity") / F.lag("equity").over(series()) - 1))
    e = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.min_by("equity", "bar_idx").alias("_first"),
        F.max_by("equity", "bar_idx").alias("_last"),
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_sd"),
    )
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    t = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.when(lost > 0, won / lost).alias("profit_factor"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum(F.col("exit_idx") - F.col("entry_idx") + 1).alias("_held"),
        F.sum("costs").alias("total_costs"),
    )
    year = (MINUTES_PER_YEAR / timeframe_minutes) ** 0.5
    return e.join(drawdowns(equity), "symbol").join(t, "symbol", "left").select(
        "symbol",
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        F.when(F.col("_first") > 0, F.col("_last") / F.col("_first") - 1).otherwise(0.0).alias("total_return"),
        "max_drawdown",
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * year).alias("sharpe_annualized"),
        "profit_factor",
        "win_rate",
        (F.coalesce("_held", F.lit(0)) / F.col("n_bars")).alias("exposure"),
        F.coalesce("total_costs", F.lit(0.0)).alias("total_costs"),
    )
