"""DuckDB SQL of the registered queries, written from the definitions."""

from __future__ import annotations

from itertools import combinations

import numpy as np

BARS = """
hours AS (
  SELECT event_type AS symbol, (epoch_us(ts) // 3600000000) * 3600 AS ts, arg_min(value, row(e.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, row(e.ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events e WHERE e.ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type, (epoch_us(ts) // 3600000000) * 3600
), bars AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx, ts, open, high, low, close, volume FROM hours
)"""
W = "PARTITION BY symbol ORDER BY bar_idx"


def fr(p: int) -> str:
    return f"({W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join([BARS, *parts]) + " "


def full(x: str, p: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {fr(p)} = {p} THEN {value} END"


def point(**columns: str) -> str:
    """One expression for each output over the bars."""
    return with_(f" r AS (SELECT *, lag(close) OVER ({W}) AS pc FROM bars)") + "SELECT symbol, bar_idx, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM r"


def avg(x: str, p: int) -> str:
    return f"avg({x}) OVER {fr(p)}"


TR = " tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, lag(close) OVER (%s) AS pc FROM bars))" % W
STEP = " st AS (SELECT *, abs(close - lag(close) OVER (%s)) AS ad, close - lag(close) OVER (%s) AS d, lag(close, 24) OVER (%s) AS c24 FROM bars)" % (W, W, W)
ATR14 = full("tr", 14, avg("tr", 14))
FEATURES = (
    TR
    + ", fe AS (SELECT *, CASE WHEN count(ad) OVER "
    + fr(24)
    + " = 24 AND sum(ad) OVER "
    + fr(24)
    + " > 0 THEN abs(close - c24) / sum(ad) OVER "
    + fr(24)
    + " END AS er, "
    + ATR14
    + " AS atr, close / nullif(pc, 0) - 1 AS ret FROM (SELECT *, abs(close - pc) AS ad, lag(close, 24) OVER (%s) AS c24 FROM tr))" % W
    + ", ft AS (SELECT *, atr / nullif(close, 0) AS atr_pct FROM fe)"
)
ROUTER = " ro AS (SELECT symbol, CASE WHEN count(er) >= 60 AND count(atr_pct) >= 60 THEN median(er) END AS er_threshold, CASE WHEN count(er) >= 60 AND count(atr_pct) >= 60 THEN median(atr_pct) END AS vol_threshold FROM ft GROUP BY symbol)"
RAW = " raws AS (SELECT symbol, bar_idx, CAST(CASE WHEN er IS NULL OR atr_pct IS NULL OR er_threshold IS NULL THEN 0 WHEN er > er_threshold AND atr_pct > vol_threshold THEN 1 WHEN er > er_threshold THEN 2 WHEN atr_pct > vol_threshold THEN 3 ELSE 4 END AS INTEGER) AS raw FROM ft JOIN ro USING (symbol))"
DWELL = (
    " runs AS (SELECT *, sum(n) OVER (%s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN raw = lag(raw) OVER (%s) THEN 0 ELSE 1 END AS n FROM raws))" % (W, W)
    + ", posi AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY bar_idx) AS pos FROM runs)"
    + ", dwelt AS (SELECT symbol, bar_idx, raw, CAST(coalesce(last_value(CASE WHEN pos >= 6 AND raw <> 0 THEN raw END IGNORE NULLS) OVER (%s ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS regime FROM posi)" % W
)
#: Signals: the close crosses its 10-bar mean; stop and target in 14-bar mean ranges.
SIGNALS = (
    TR
    + ", sg AS (SELECT *, coalesce(lag(close) OVER (%s) <= lag(m) OVER (%s) AND close > m, false) AS entry_long, coalesce(lag(m) OVER (%s) <= lag(close) OVER (%s) AND m > close, false) AS entry_short, max(bar_idx) OVER (PARTITION BY symbol) AS last_idx" % (W, W, W, W)
    + " FROM (SELECT *, %s AS m, %s AS atr FROM tr))" % (full("close", 10, avg("close", 10)), ATR14)
)


def candidates(spread: float = 2.0) -> str:
    hs = spread * 0.01 / 2
    return (
        SIGNALS
        + f""", ca AS (
  SELECT symbol, bar_idx AS signal_idx, bar_idx + 1 AS entry_idx, direction, fill, stop, fill - direction * stop AS sl, fill + direction * 1.5 * atr AS tp, least(bar_idx + 1 + 12, last_idx) AS until_idx, last_idx
  FROM (SELECT *, o1 + direction * {hs!r} AS fill, CASE WHEN atr > 0 THEN 1.0 * atr END AS stop
    FROM (SELECT *, CAST(CASE WHEN entry_long THEN 1 ELSE -1 END AS INTEGER) AS direction, lead(open) OVER ({W}) AS o1 FROM sg))
  WHERE entry_long <> entry_short AND bar_idx < last_idx
), sc AS (
  SELECT c.symbol, c.signal_idx, b.bar_idx, c.entry_idx, direction AS d, sl, tp, c.last_idx,
    open - direction * {hs!r} AS qo, CASE WHEN direction > 0 THEN low ELSE high END - direction * {hs!r} AS worst, CASE WHEN direction > 0 THEN high ELSE low END - direction * {hs!r} AS best, close - direction * {hs!r} AS qc
  FROM ca c JOIN bars b ON b.symbol = c.symbol AND b.bar_idx BETWEEN c.entry_idx AND c.until_idx WHERE stop IS NOT NULL
), hit AS (
  SELECT *, CASE WHEN d * worst <= d * sl THEN 'sl' WHEN d * best >= d * tp THEN 'tp' WHEN bar_idx - entry_idx >= 12 THEN 'max_bars' WHEN bar_idx = last_idx THEN 'end_of_data' END AS reason,
    CASE WHEN d * worst <= d * sl THEN d * least(d * qo, d * sl) WHEN d * best >= d * tp THEN CASE WHEN d * qo >= d * tp THEN qo ELSE tp END ELSE qc END AS price FROM sc
), ex AS (
  SELECT symbol, signal_idx, min(bar_idx) AS exit_idx, arg_min(price, bar_idx) AS exit_price, arg_min(reason, bar_idx) AS exit_reason FROM hit WHERE reason IS NOT NULL GROUP BY ALL
)"""
    )


def _lots(qty: str) -> str:
    return f"CASE WHEN ({qty}) < 0.01 THEN 0.0 ELSE least(round(floor((({qty}) - 0.01) / 0.01 + 1e-9) * 0.01 + 0.01, 12), 1000000.0) END"


def fold(spread: float = 2.0) -> str:
    qty = "CASE WHEN f.cash * 0.01 / c.stop * c.fill > f.cash THEN f.cash / c.fill ELSE f.cash * 0.01 / c.stop END"
    return (
        candidates(spread)
        + f""", cx AS (SELECT c.*, exit_idx, exit_price, exit_reason FROM ca c LEFT JOIN ex USING (symbol, signal_idx)
), fo AS (
  SELECT symbol, CAST(-1 AS BIGINT) AS signal_idx, CAST(-1 AS BIGINT) AS entry_idx, CAST(-1 AS BIGINT) AS exit_idx, 0 AS direction, CAST(NULL AS DOUBLE) AS fill, CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS VARCHAR) AS exit_reason,
    CAST(0 AS DOUBLE) AS lots, CAST(0 AS DOUBLE) AS costs, CAST(0 AS DOUBLE) AS pnl, CAST(100000 AS DOUBLE) AS before, CAST(100000 AS DOUBLE) AS cash, CAST(-1 AS BIGINT) AS busy, CAST(NULL AS VARCHAR) AS skip
  FROM (SELECT DISTINCT symbol FROM bars)
  UNION ALL
  SELECT symbol, signal_idx, entry_idx, exit_idx, direction, fill, exit_price, exit_reason, lots, costs, (exit_price - fill) * lots * direction - costs, cash,
    CASE WHEN skip IS NULL THEN cash + (exit_price - fill) * lots * direction - costs ELSE cash END, CASE WHEN skip IS NULL THEN exit_idx + 2 ELSE busy END, skip
  FROM (SELECT *, lots * fill * 0.001 + abs(exit_price) * lots * 0.001 AS costs
    FROM (SELECT *, CASE WHEN skip IS NULL THEN raw_lots ELSE 0.0 END AS lots
      FROM (SELECT *, CASE WHEN stop IS NULL THEN 'atr_invalid' WHEN raw_lots <= 0 THEN 'below_min_lot' END AS skip
        FROM (SELECT c.*, f.cash, f.busy, {_lots(qty)} AS raw_lots, row_number() OVER (PARTITION BY c.symbol ORDER BY c.signal_idx) AS rn
          FROM fo f JOIN cx c ON c.symbol = f.symbol AND c.signal_idx > f.signal_idx AND c.signal_idx >= f.busy)
        WHERE rn = 1)))
), trades AS (SELECT * FROM fo WHERE skip IS NULL AND signal_idx >= 0)"""
    )


EQUITY = f""" eq AS (
  SELECT b.symbol, b.bar_idx, CASE WHEN t.entry_idx IS NULL THEN 100000.0
    WHEN b.bar_idx < t.exit_idx THEN t.before - t.lots * t.fill * 0.001 + (b.close - t.direction * 0.01 - t.fill) * t.lots * t.direction ELSE t.before + t.pnl END AS equity
  FROM bars b ASOF LEFT JOIN trades t ON b.symbol = t.symbol AND b.bar_idx >= t.entry_idx
), dd AS (
  SELECT symbol, max((peak - equity) / peak) AS max_drawdown FROM (SELECT *, max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM eq) GROUP BY symbol
)"""

CANDIDATES = """
years AS (
  SELECT 'c' || CAST(o_custkey % 60 AS VARCHAR) AS candidate, CAST(o_custkey % 60 AS INTEGER) AS num, year(o_orderdate) AS y, round(avg(o_totalprice) / 250000 - 0.5, 4) AS r, count(*) AS n,
    sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_totalprice ELSE 0 END) AS won, sum(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice ELSE 0 END) AS lost
  FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL
), cand AS (
  SELECT candidate, list(r ORDER BY y) AS fold_returns, CAST(sum(n) AS BIGINT) AS n_trades_total, round(max(r) - min(r), 4) AS max_drawdown,
    CASE WHEN sum(lost) > 0 THEN round(sum(won) / sum(lost), 4) END AS profit_factor, (num * 7) % 150 AS complexity,
    round(sum(n) % 40 / 200.0, 4) AS trade_frequency, CAST((num * 13) % 70 AS DOUBLE) AS avg_holding_bars, round((num % 11) / 10.0, 4) AS long_share, round((num % 9) / 8.0, 4) AS win_rate
  FROM years GROUP BY candidate, num
), ob AS (
  SELECT *, list_median(fold_returns) AS med, list_stddev_pop(fold_returns) AS sd, coalesce(profit_factor, 0.0) AS pf FROM cand
), obj AS (
  SELECT *, round(med, 6) AS median_fold_return, -max_drawdown AS neg_max_drawdown, least(pf, 10.0) AS profit_factor_capped, round(-sd, 6) AS neg_fold_dispersion, -CAST(complexity AS DOUBLE) AS neg_complexity,
    greatest(0.0, 30 - n_trades_total) / 30 AS v_trades, greatest(0.0, max_drawdown - 0.25) AS v_drawdown, greatest(0.0, 1.0 - pf) AS v_profit_factor, greatest(0.0, 0.0 - med) AS v_median,
    greatest(0.0, sd - 0.5) AS v_dispersion, greatest(0.0, complexity - 120) / 120 AS v_complexity FROM ob
), vio AS (
  SELECT *, round(v_trades + v_drawdown + v_profit_factor + v_median + v_dispersion + v_complexity, 6) AS total_violation FROM obj
)"""
_O = ("median_fold_return", "neg_max_drawdown", "profit_factor_capped", "neg_fold_dispersion", "neg_complexity")
BEATS = "(" + " AND ".join(f"a.{o} >= b.{o}" for o in _O) + ") AND (" + " OR ".join(f"a.{o} > b.{o}" for o in _O) + ")"
#: The front of a candidate is the length of the longest chain of candidates that beat one another above it.
FRONTS = f""", beat AS (SELECT a.candidate AS a, b.candidate AS b FROM vio a JOIN vio b ON {BEATS}
), chain AS (
  SELECT candidate, 0 AS k FROM vio UNION SELECT b, k + 1 FROM chain JOIN beat ON beat.a = chain.candidate
), fro AS (SELECT candidate, CAST(max(k) AS INTEGER) AS front FROM chain GROUP BY candidate
), ranked AS (SELECT vio.*, front, total_violation = 0 AS feasible FROM vio JOIN fro USING (candidate))"""


def crowd() -> str:
    parts, columns = [], []
    for k, o in enumerate(_O):
        w = f"(PARTITION BY front ORDER BY {o}, candidate)"
        span = f"(max({o}) OVER (PARTITION BY front) - min({o}) OVER (PARTITION BY front))"
        columns.append(f"CASE WHEN {span} <= 0 THEN 0.0 WHEN lag({o}) OVER {w} IS NULL OR lead({o}) OVER {w} IS NULL THEN CAST('inf' AS DOUBLE) ELSE (lead({o}) OVER {w} - lag({o}) OVER {w}) / nullif({span}, 0) END AS d{k}")
        parts.append(f"d{k}")
    return ", cro AS (SELECT *, CASE WHEN n <= 2 THEN CAST('inf' AS DOUBLE) ELSE " + " + ".join(parts) + " END AS crowding FROM (SELECT *, count(*) OVER (PARTITION BY front) AS n, " + ", ".join(columns) + " FROM ranked))"


BATTERY = """
six AS (
  SELECT event_type AS cand, epoch_us(ts) // 21600000000 AS b, avg(value) AS m FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL
), ret AS (
  SELECT cand, b, round(m / nullif(lag(m) OVER (PARTITION BY cand ORDER BY b), 0) - 1, 6) AS ret FROM six
), battery AS (
  SELECT dense_rank() OVER (ORDER BY b) - 1 AS t, cand, ret FROM ret WHERE ret IS NOT NULL
)"""


#: Twenty circular bootstrap series of blocks of ten steps, as long as the battery; starts as in `catalogue._starts`.
RESAMPLED = """, len AS (SELECT max(t) + 1 AS n FROM battery
), starts AS (
  SELECT sample, block_no, ((sample * 1000003 + block_no + 1) * 2654435761 % 4294967296) % n AS start
  FROM (SELECT s.range AS sample, n, unnest(range((n + 9) // 10)) AS block_no FROM range(20) AS s, len)
), boot AS (
  SELECT sample, cand, ret FROM (SELECT sample, block_no * 10 + o AS pos, (start + o) % n AS t, n FROM starts, range(10) AS r(o), len) JOIN battery USING (t) WHERE pos < n
)"""

#: The walk-forward plan for all bars of the longest series: tests tile the end before the lockbox, training grows up to the purge,
#: without the embargo after earlier tests; validation tiles the end of each training.
PLAN = """ len AS (SELECT max(bar_idx) + 1 AS n FROM bars
), tests AS (
  SELECT k, n, n // 20 AS v, n - n // 8 - 8 - 3 * (n // 10) + k * (n // 10) AS a, n // 10 AS w, n - n // 8 AS locked FROM len, range(3) AS r(k)
), pieces AS (
  SELECT t.k, t.v, t.a - 8 AS until, CASE WHEN i = 0 THEN 0 ELSE t.a - (t.k - i) * t.w + 4 END AS start, CASE WHEN i = greatest(t.k, 1) - 1 THEN t.a - 8 ELSE t.a - (t.k - i - 1) * t.w END AS stop
  FROM (SELECT *, unnest(range(greatest(k, 1))) AS i FROM tests) AS t
), vals AS (
  SELECT k, j, a - 8 - (2 - j) * v AS start, a - 8 - (1 - j) * v AS stop FROM tests, range(2) AS r(j)
), pl AS (
  SELECT -1 AS plan, -1 AS inner_fold, 'lockbox' AS role, locked AS start, n AS stop FROM tests WHERE k = 0
  UNION ALL SELECT k, -1, 'train', start, stop FROM pieces
  UNION ALL SELECT k, -1, 'test', a, a + w FROM tests
  UNION ALL SELECT p.k, j, 'inner_train', p.start, least(p.stop, x.start - 8) FROM pieces p JOIN vals x USING (k) WHERE p.start < x.start - 8
  UNION ALL SELECT k, j, 'validation', start, stop FROM vals
)"""

#: Test groups of every choice of two of six equal groups of all bars.
CPCV = """ len AS (SELECT max(bar_idx) + 1 AS n FROM bars
), groups AS (
  SELECT g, CAST(round_even(g * n / 6.0, 0) AS BIGINT) AS a, CAST(round_even((g + 1) * n / 6.0, 0) AS BIGINT) AS b FROM len, range(6) AS r(g)
), pairs AS (
  SELECT x.g AS g1, y.g AS g2, row_number() OVER (ORDER BY x.g, y.g) - 1 AS split FROM groups x JOIN groups y ON x.g < y.g
), pl AS (SELECT split, a, b FROM pairs JOIN groups ON g IN (g1, g2))"""


def combos(groups: int) -> str:
    rows = [f"({k}, {g}, {str(g in chosen).lower()})" for k, chosen in enumerate(combinations(range(1, groups + 1), groups // 2)) for g in range(1, groups + 1)]
    return "(VALUES " + ", ".join(rows) + ") AS v(combo, grp, inside)"


def values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS v({names})"
