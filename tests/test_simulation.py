import numpy as np
import pytest

from barloom.errors import MetadataError, PolicyError
from barloom.operators import simulate as S
from barloom.streaming import ticks
from tests.helpers import random_bars, sequential


def flat(n=20, price=100.0):
    return [{"symbol": "A", "bar_idx": i, "ts": i * 3600, "open": price, "high": price, "low": price, "close": price, "volume": 1.0, "entry_long": False, "entry_short": False, "allow": True, "atr": 1.0} for i in range(n)]


COSTS = S.Costs(spread_points=2.0, commission_pct=0.001, max_leverage=10.0)


def play(spark, rows, risk, costs=COSTS):
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, ts long, open double, high double, low double, close double, volume double, entry_long boolean, entry_short boolean, allow boolean, atr double")
    done = S.simulate(df, risk, costs).cache()
    return df, S.trades_of(done).collect(), S.skipped_of(done).collect()


def test_flat_long_by_hand(spark):
    rows = flat()
    rows[5]["entry_long"] = True
    df, trades, _ = play(spark, rows, S.Risk(sl_atr=2, tp_atr=3, max_bars=3))
    (t,) = trades
    assert (t.entry_idx, t.exit_idx, t.exit_reason) == (6, 9, "max_bars")
    assert t.entry_price == pytest.approx(100.01) and t.exit_price == pytest.approx(99.99)
    assert t.qty == pytest.approx(500) and t.lots == pytest.approx(0.5) and t.costs == pytest.approx(100) and t.pnl == pytest.approx(-110)
    eq = [r.equity for r in S.equity_curve(df, S.trades_of(S.simulate(df, S.Risk(sl_atr=2, tp_atr=3, max_bars=3), COSTS)), COSTS).orderBy("bar_idx").collect()]
    assert eq[6] == pytest.approx(99_939.995) and eq[-1] == pytest.approx(99_890)


def test_gap_through_the_stop_fills_at_the_open(spark):
    rows = flat(8)
    rows[2]["entry_long"] = True
    for r in rows[5:]:
        r.update(open=95.0, high=95.0, low=95.0, close=95.0)
    _, (t,), _ = play(spark, rows, S.Risk(sl_atr=1, tp_atr=3, max_bars=50))
    assert t.exit_reason == "sl" and t.sl == pytest.approx(99.01) and t.exit_price == pytest.approx(94.99)


def test_stop_before_target_in_one_bar(spark):
    rows = flat(6)
    rows[2]["entry_long"] = True
    rows[4].update(high=104.0, low=97.0)
    _, (t,), _ = play(spark, rows, S.Risk(sl_atr=2, tp_atr=3, max_bars=50))
    assert t.exit_reason == "sl" and t.exit_price == pytest.approx(t.sl)


def test_flat_short(spark):
    rows = flat(10)
    rows[5]["entry_short"] = True
    _, (t,), _ = play(spark, rows, S.Risk(sl_atr=2, tp_atr=3, max_bars=2))
    assert (t.direction, t.sl, t.tp) == (-1, pytest.approx(101.99), pytest.approx(96.99)) and t.exit_price == pytest.approx(100.01)


def test_conflict_gate_missing_range_and_end(spark):
    rows = flat(10)
    rows[3].update(entry_long=True, entry_short=True)
    assert play(spark, rows, S.Risk())[1:] == ([], [])
    rows[3].update(entry_short=False, allow=False)
    assert play(spark, rows, S.Risk())[1:] == ([], [])
    rows[3].update(allow=True, atr=None)
    _, trades, skipped = play(spark, rows, S.Risk())
    assert not trades and [(r.bar_idx, r.reason) for r in skipped] == [(4, "atr_invalid")]
    rows[3].update(atr=1.0)
    _, (t,), _ = play(spark, rows, S.Risk(max_bars=50))
    assert (t.exit_idx, t.exit_reason) == (9, "end_of_data")


def test_cooldown_and_funding(spark):
    rows = flat(30)
    for r in rows:
        r["entry_long"] = True
    _, trades, _ = play(spark, rows, S.Risk(max_bars=2, cooldown_bars=10))
    assert trades[1].entry_idx - trades[0].exit_idx > 10
    _, (t, *_), _ = play(spark, rows, S.Risk(max_bars=4), S.Costs(spread_points=2.0, commission_pct=0.0, funding_long=24.0, max_leverage=10.0))
    assert t.costs == pytest.approx(24 * 0.01 * t.qty / 24 * 5)


@pytest.mark.parametrize("seed", range(4))
def test_decomposition_equals_the_sequence(spark, seed):
    rng = np.random.default_rng(seed)
    bars = random_bars(200, seed, ("A", "B"))
    n = len(bars)
    bars["entry_long"], bars["entry_short"], bars["allow"] = rng.random(n) < 0.2, rng.random(n) < 0.2, rng.random(n) < 0.9
    bars["atr"] = np.where(rng.random(n) < 0.1, np.nan, rng.uniform(0.2, 2, n))
    bars = bars.astype(object).where(bars.notna(), None)
    risk = S.Risk(sl_atr=1.0, tp_atr=1.5, max_bars=int(rng.integers(2, 15)), cooldown_bars=int(rng.integers(0, 6)))
    costs = S.Costs(lot_size=1.0, max_lot=1e6, slippage_points=1.0, funding_long=1.0, funding_short=-0.5)
    df, trades, skipped = play(spark, bars.to_dict("records"), risk, costs)
    for s in ("A", "B"):
        want, want_skipped, equity = sequential(bars[bars.symbol == s], risk, costs)
        got = [(t.entry_idx, t.exit_idx, t.direction, t.entry_price, t.exit_price, t.qty, t.pnl, t.costs, t.exit_reason) for t in sorted(trades, key=lambda t: t.entry_idx) if t.symbol == s]
        assert [(*g[:3], g[-1]) for g in got] == [(*w[:3], w[-1]) for w in want]
        np.testing.assert_allclose([g[3:8] for g in got], [w[3:8] for w in want], rtol=1e-9)
        assert sorted((r.bar_idx, r.direction, r.reason) for r in skipped if r.symbol == s) == sorted(want_skipped)
        done = S.simulate(df, risk, costs)
        eq = [r.equity for r in S.equity_curve(df, S.trades_of(done), costs).where(f"symbol = '{s}'").orderBy("bar_idx").collect()]
        np.testing.assert_allclose(eq, equity, rtol=1e-9)


def test_drawdown(spark):
    df = spark.createDataFrame([("A", i, float(e)) for i, e in enumerate((100, 110, 99, 120, 90))], "symbol string, bar_idx long, equity double")
    assert S.drawdowns(df).first().max_drawdown == pytest.approx(0.25)


def test_costs_fail_closed():
    spec = dict(symbol="X", tick_size=0.01, lot_size=1000.0, min_lot=0.01, max_lot=10.0, lot_step=0.01, spread_source="static_header", swap_long=None, swap_short=None, min_notional=None)
    good = dict(assumed_spread_points=10.0, commission_pct_notional=0.001, funding_mode="not_applicable_spot", min_notional=5.0)
    assert S.resolve_costs(spec, False, good).spread_points == 10.0
    for broken in ({"assumed_spread_points": None}, {"assumed_spread_points": 0}, {"commission_pct_notional": None}, {"funding_mode": None}, {"funding_mode": "points_per_day_from_spec"}, {"min_notional": None}):
        with pytest.raises(MetadataError):
            S.resolve_costs(spec, False, good | broken)
    with pytest.raises(PolicyError):
        S.Risk(sl_atr=0)


def test_ticks_fill_with_latency_and_gap():
    risk, costs = S.Risk(sl_atr=1.0, tp_atr=50.0, max_bars=100), S.Costs(lot_size=1.0, max_lot=1e6, commission_pct=0.0)
    for latency, fill in ((0.0, 100.01), (1000.0, 99.01)):
        e = ticks.Engine(risk, costs, 3600, latency=latency)
        signal = {"bar_idx": 0, "ts": 0.0, "entry_long": True, "entry_short": False, "allow": True, "atr": 5.0}
        e.on_quote(3600.0, 99.99, 100.01, 1, [signal], 3)
        e.on_quote(4700.0, 98.99, 99.01, 1, [], 3)
        assert e.position.price == pytest.approx(fill)
        e.on_quote(5000.0, 92.99, 93.01, 1, [], 3)
        assert e.trades[0][4] == pytest.approx(92.99) and e.trades[0][-1] == "sl"
    with pytest.raises(PolicyError):
        e.on_quote(1.0, 1.0, 1.1, 0, [], 3)
    with pytest.raises(PolicyError):
        e.on_quote(9e9, 1.0, 0.9, 0, [], 3)
