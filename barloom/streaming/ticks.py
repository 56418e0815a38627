"""The tick engine: quotes in order, bar signals read at bar closes, fills at the quotes that come.

On every quote, in this order: a resting stop or target fills at the quote; a
pending order fills once its latency has passed; bar closes that the quote has
passed are worked off (funding, time stop, mark, signal); a pending order is
tried again.  What is still open at the end is closed at the last quote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.errors import PolicyError
from barloom.operators.simulate import Costs, Risk
from barloom.session import ship


def lots_for(cash: float, stop: float, price: float, risk: Risk, c: Costs) -> float:
    if not stop > 0 or price <= 0:
        return 0.0
    quantity = min(cash * risk.risk_per_trade / stop, cash * c.max_leverage / price) / c.lot_size
    if quantity < c.min_lot:
        return 0.0
    lots = min(round(math.floor((quantity - c.min_lot) / c.lot_step + 1e-9) * c.lot_step + c.min_lot, 12), c.max_lot)
    return lots if lots * c.lot_size * price >= c.min_notional else 0.0


@dataclass
class Position:
    direction: int
    entry_idx: int
    price: float
    lots: float
    sl: float
    tp: float
    costs: float


class Engine:
    """One series; its state is a position, an order and a few numbers."""

    def __init__(self, risk: Risk, costs: Costs, seconds: int, equity: float = 100_000.0, latency: float = 0.0) -> None:
        self.risk, self.costs, self.seconds, self.cash, self.latency = risk, costs, seconds, equity, latency
        self.position: Position | None = None
        self.order: tuple[int, int, float, float] | None = None  # direction, signal bar, its range, signal time
        self.cooldown = -1
        self.last_ts = -math.inf
        self.quote = (0.0, 0.0)
        self.trades: list[tuple] = []
        self.equity: dict[int, float] = {}

    @property
    def slip(self) -> float:
        return self.costs.slippage_points * self.costs.tick_size

    def _exit(self, price: float, bar: int, reason: str) -> None:
        p = self.position
        price -= p.direction * self.slip
        qty = p.lots * self.costs.lot_size
        fee = abs(price) * qty * self.costs.commission_pct
        gross = (price - p.price) * qty * p.direction
        self.cash += gross - fee
        self.trades.append((p.direction, p.entry_idx, bar, p.price, price, p.lots, gross - p.costs - fee, reason))
        self.cooldown, self.position = bar + self.risk.cooldown_bars, None

    def _fill(self, ts: float, bar: int, n_bars: int) -> None:
        if self.order is None or self.position is not None or ts < self.order[3] + self.latency:
            return
        direction, signal, spread, _ = self.order
        self.order = None
        bid, ask = self.quote
        price = ask + self.slip if direction > 0 else bid - self.slip
        stop = self.risk.sl_atr * spread
        lots = lots_for(self.cash, stop, price, self.risk, self.costs)
        if lots <= 0:
            return
        fee = lots * self.costs.lot_size * price * self.costs.commission_pct
        self.cash -= fee
        self.position = Position(direction, min(signal + 1, n_bars - 1), price, lots, price - direction * stop, price + direction * self.risk.tp_atr * spread, fee)

    def close_bar(self, bar: dict, n_bars: int) -> None:
        """`bar`: bar_idx, ts (of its start), entry_long, entry_short, allow, atr."""
        i, p = bar["bar_idx"], self.position
        bid, ask = self.quote
        if p is not None:
            points = self.costs.funding_long if p.direction > 0 else self.costs.funding_short
            fee = points * self.costs.tick_size * p.lots * self.costs.lot_size * self.seconds / 86_400
            self.cash -= fee
            p.costs += fee
            if i - p.entry_idx >= self.risk.max_bars:
                self._exit(bid if p.direction > 0 else ask, i, "max_bars")
        p = self.position
        held = 0.0 if p is None else ((bid if p.direction > 0 else ask) - p.price) * p.lots * self.costs.lot_size * p.direction
        self.equity[i] = self.cash + held
        able = p is None and self.order is None and i < n_bars - 1 and bar["allow"] and i >= self.cooldown
        if able and bar["entry_long"] != bar["entry_short"] and bar["atr"] is not None and bar["atr"] > 0:
            self.order = (1 if bar["entry_long"] else -1, i, bar["atr"], bar["ts"] + self.seconds)

    def on_quote(self, ts: float, bid: float, ask: float, bar_idx: int, closed: list[dict], n_bars: int) -> None:
        """`closed`: bars whose close this quote is the first to have passed; they close at the quote."""
        if ts < self.last_ts:
            raise PolicyError("quotes out of order", ts=ts, before=self.last_ts)
        if ask < bid:
            raise PolicyError("ask below bid", ts=ts)
        self.last_ts, self.quote = ts, (bid, ask)
        p = self.position
        if p is not None:
            price = bid if p.direction > 0 else ask
            if p.direction * price <= p.direction * p.sl:
                self._exit(price, bar_idx, "sl")
            elif p.direction * price >= p.direction * p.tp:
                self._exit(price, bar_idx, "tp")
        self._fill(ts, bar_idx, n_bars)
        for bar in closed:
            self.close_bar(bar, n_bars)
        self._fill(ts, bar_idx, n_bars)

    def finish(self, bar_idx: int) -> None:
        if self.position is not None:
            self._exit(self.quote[0] if self.position.direction > 0 else self.quote[1], bar_idx, "end_of_data")


_TRADES = "symbol string, direction int, entry_idx long, exit_idx long, entry_price double, exit_price double, lots double, pnl double, exit_reason string"


def run(quotes: DataFrame, signals: DataFrame, risk: Risk, costs: Costs, seconds: int, equity: float = 100_000.0, latency: float = 0.0) -> DataFrame:
    """Trades of every series: quotes (symbol, ts, event_id, bid, ask) and bars with signals in one sorted pass.

    Bars are merged in at their closes; only one bar list and one position are
    held for a series.
    """
    n_bars = signals.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    q = quotes.select("symbol", "ts", F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("seq"), "bid", "ask", *(F.lit(None).cast(t).alias(c) for c, t in (("bar_idx", "long"), ("bar_ts", "double"), ("entry_long", "boolean"), ("entry_short", "boolean"), ("allow", "boolean"), ("atr", "double"))))
    b = signals.select("symbol", (F.col("ts") + seconds).cast("double").alias("ts"), F.lit(0).alias("kind"), F.col("bar_idx").alias("seq"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"), "bar_idx", F.col("ts").cast("double").alias("bar_ts"), "entry_long", "entry_short", "allow", "atr")
    parts = int(ship(signals.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    rows = q.unionByName(b).join(n_bars, "symbol").repartition(parts, "symbol").sortWithinPartitions("symbol", "ts", "kind", "seq")
    names = [c.split()[0] for c in _TRADES.split(", ")]

    def play(batches):
        now, engine, closed, bar, n = None, None, [], 0, 0

        def flush():
            engine.finish(n - 1)
            columns = list(zip(*engine.trades)) or [[]] * 8
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(engine.trades), pa.string()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

        for batch in batches:
            for row in batch.to_pylist():
                if engine is None or row["symbol"] != now:
                    if engine is not None:
                        yield flush()
                    now, engine, closed, bar, n = row["symbol"], Engine(risk, costs, seconds, equity, latency), [], 0, row["n_bars"]
                if row["kind"] == 0:
                    closed.append({"bar_idx": row["bar_idx"], "ts": row["bar_ts"], **{k: row[k] for k in ("entry_long", "entry_short", "allow", "atr")}})
                    bar = row["bar_idx"] + 1
                else:
                    engine.on_quote(row["ts"], row["bid"], row["ask"], min(bar, n - 1), closed, n)
                    closed = []
        if engine is not None:
            for c in closed:
                engine.close_bar(c, n)
            yield flush()

    return rows.mapInArrow(play, _TRADES)
