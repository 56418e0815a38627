"""Registered queries of sweeps, orders, layers, hash trees and records, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import catalogue_sql as S
from barloom.catalogue import _BAT, _CAND_R, _resampling, bars, battery, evaluated, query, r, rounded, scored, signals, table
from barloom.governance import content_tree  # noqa: F401  (part of the tree's interface)
from barloom.operators import hashtree, memory, ordinals, parity, posterior, ranking, regimes, stats, sweep
from barloom.session import checkpoint_dir
from barloom.sources import bars as B

def _micros() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at")


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- as-of joins ---------------------------------------------------------------------


@query(
    """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS click_value FROM events WHERE event_type = 'click' AND event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
    SELECT event_id, click_id, click_value FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts > c.ts"""
)
def asof_last_click(spark, d):
    """For every event the last click of its user before it."""
    e = table(spark, d, "events").select("event_id", "user_id", _micros(), "event_type", "value")
    clicks = e.where("event_type = 'click' AND event_id IS NOT NULL").select("user_id", "at", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return sweep.asof_join(e, clicks, ["user_id"], "at", ["click_id", "click_value"], ["click_id"], strict=True).select("event_id", "click_id", "click_value")


@query(
    S.with_()
    + """, t AS (SELECT event_type AS symbol, epoch_us(ts) AS at, arg_max(value, event_id) AS quote FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL),
    g AS (SELECT symbol, unnest(range(lo, hi + 1800, 1800)) AS boundary FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol)),
    j AS (SELECT g.symbol, boundary, t.at AS seen, quote FROM g ASOF LEFT JOIN t ON g.symbol = t.symbol AND boundary * 1000000 >= t.at)
    SELECT symbol, boundary, CASE WHEN boundary * 1000000 - seen <= 1800000000 THEN quote END AS quote FROM j"""
)
def asof_boundaries(spark, d):
    """The last quote of each series at every half hour, if it is no older than that."""
    span = bars(spark, d).groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = span.select("symbol", F.explode(F.sequence("lo", F.col("lo") + F.floor((F.col("hi") + 1799 - F.col("lo")) / 1800) * 1800, F.lit(1800))).alias("boundary")).withColumn("at", F.col("boundary") * 1_000_000)
    quotes = table(spark, d, "events").where("value is not null and event_id is not null").select(F.col("event_type").alias("symbol"), _micros(), F.col("value").alias("quote"), "event_id")
    return sweep.asof_join(grid, quotes, ["symbol"], "at", ["quote"], ["event_id"], tolerance=1_800_000_000).select("symbol", "boundary", "quote")


# ---- ranges --------------------------------------------------------------------------


def _day(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


@query(
    """WITH cuts AS (SELECT l_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, s + 10 AS e FROM lineitem WHERE l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL),
    whole AS (SELECT o_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a, a + 150 AS b FROM orders WHERE o_orderkey IS NOT NULL AND o_orderdate IS NOT NULL),
    seen AS (SELECT k, a, b, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM whole JOIN cuts USING (k)),
    gaps AS (
      SELECT k, greatest(a, coalesce(before, a)) AS start, least(b, s) AS stop FROM seen
      UNION ALL SELECT k, greatest(a, max(e)), b FROM seen GROUP BY k, a, b
      UNION ALL SELECT k, a, b FROM whole WHERE k NOT IN (SELECT k FROM cuts))
    SELECT k AS o_orderkey, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM gaps WHERE start < stop"""
)
def order_gaps(spark, d):
    """The days of the 150 after each order that no shipment's ten days cover."""
    whole = table(spark, d, "orders").where("o_orderkey is not null and o_orderdate is not null").select("o_orderkey", _day("o_orderdate").alias("start"), (_day("o_orderdate") + 150).alias("stop"))
    cuts = table(spark, d, "lineitem").where("l_orderkey is not null and l_shipdate is not null").select(F.col("l_orderkey").alias("o_orderkey"), _day("l_shipdate").alias("start"), (_day("l_shipdate") + 10).alias("stop"))
    return sweep.subtract(whole, cuts, ["o_orderkey"])


_DAYS = """WITH o AS (SELECT o_custkey AS k, o_orderstatus AS st, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
    days AS (SELECT DISTINCT k, st, unnest(range(s, s + 60)) AS day FROM o) """
_ISLANDS = " SELECT k AS o_custkey, CAST(min(day) AS BIGINT) AS start, CAST(max(day) + 1 AS BIGINT) AS stop FROM (SELECT k, day, day - row_number() OVER (PARTITION BY k ORDER BY day) AS island FROM picked) GROUP BY k, island"


def _windows(spark, d, status: str | None = None) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey is not null and o_orderdate is not null")
    o = o.where(F.col("o_orderstatus") == status) if status else o
    return o.select("o_custkey", _day("o_orderdate").alias("start"), (_day("o_orderdate") + 60).alias("stop"))


@query(_DAYS + ", picked AS (SELECT DISTINCT k, day FROM days)" + _ISLANDS)
def customer_cover(spark, d):
    """The days on which a customer has an order of the last sixty days."""
    return sweep.cover(_windows(spark, d), ["o_custkey"])


@query(_DAYS + ", picked AS (SELECT k, day FROM days WHERE st = 'O' INTERSECT SELECT k, day FROM days WHERE st = 'F')" + _ISLANDS)
def customer_overlap(spark, d):
    """The days on which both an open and a filled order of a customer are that young."""
    return sweep.intersect(_windows(spark, d, "O"), _windows(spark, d, "F"), ["o_custkey"])


# ---- orders and layers ---------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS nth, CAST(ntile(100) OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS percentile FROM orders WHERE o_orderkey IS NOT NULL")
def orders_ranked(spark, d):
    o = table(spark, d, "orders").where("o_orderkey is not null").select("o_orderkey", "o_totalprice")
    order = [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")]
    return ordinals.ntiles(ordinals.ordinals(o, order, "nth"), ["nth"], 100, "percentile").select("o_orderkey", "nth", "percentile")


@query(
    """WITH RECURSIVE v AS (SELECT q, di, t, row_number() OVER () AS id FROM (SELECT DISTINCT l_quantity AS q, l_discount AS di, -l_tax AS t FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL)),
    beat AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.q >= b.q AND a.di >= b.di AND a.t >= b.t AND a.id <> b.id),
    chain AS (SELECT id, 0 AS k FROM v UNION SELECT b, k + 1 FROM chain JOIN beat ON beat.a = chain.id),
    layer AS (SELECT id, CAST(max(k) AS INTEGER) AS front FROM chain GROUP BY id)
    SELECT l_orderkey, l_linenumber, coalesce(front, 0) AS front FROM lineitem LEFT JOIN (SELECT * FROM v JOIN layer USING (id)) x ON x.q = l_quantity AND x.di = l_discount AND x.t = -l_tax"""
)
def lineitem_layers(spark, d):
    """The non-dominated layers of all lines by quantity, discount and low tax."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", (-F.col("l_tax")).alias("low_tax"))
    return ranking.layers(lines, ["l_quantity", "l_discount", "low_tax"]).select("l_orderkey", "l_linenumber", "front")


@query()
def lineitem_price_layers(spark, d):
    """The same by price, discount and early shipment: nearly as many different vectors as lines (no SQL: it compares all pairs)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", (-_day("l_shipdate")).alias("early"))
    return ranking.layers(lines, ["l_extendedprice", "l_discount", "early"]).select("l_orderkey", "l_linenumber", "front")


_ARCHIVED = """o AS (SELECT o_orderkey AS n, coalesce(o_orderpriority, '') AS c1, CAST(month(o_orderdate) AS INTEGER) AS c2, o_totalprice AS x, -CAST(o_custkey % 1000 AS DOUBLE) AS y, greatest(0.0, 20000 - o_totalprice) AS v
      FROM orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_custkey IS NOT NULL),
    p AS (SELECT *, v = 0 AS f, row_number() OVER (PARTITION BY c1, c2 ORDER BY n) AS rn FROM o),
    fold AS (SELECT c1, c2, rn, n, x, y, v, f, 1 AS accepted FROM p WHERE rn = 1
      UNION ALL SELECT c1, c2, rn, CASE WHEN b THEN pn ELSE n END, CASE WHEN b THEN px ELSE x END, CASE WHEN b THEN py ELSE y END, CASE WHEN b THEN pv ELSE v END, CASE WHEN b THEN pf ELSE f END, CASE WHEN b THEN accepted + 1 ELSE accepted END
      FROM (SELECT fold.c1, fold.c2, p.rn, fold.n, fold.x, fold.y, fold.v, fold.f, accepted, p.n AS pn, p.x AS px, p.y AS py, p.v AS pv, p.f AS pf,
        CASE WHEN p.f AND fold.f THEN p.x >= fold.x AND p.y >= fold.y AND (p.x > fold.x OR p.y > fold.y) WHEN p.f OR fold.f THEN p.f ELSE p.v < fold.v END AS b
        FROM fold JOIN p ON p.c1 = fold.c1 AND p.c2 = fold.c2 AND p.rn = fold.rn + 1))"""


@query("WITH RECURSIVE " + _ARCHIVED + " SELECT c1, c2, CAST(n AS VARCHAR) AS elite, CAST(accepted AS BIGINT) AS accepted, rn AS tried FROM fold QUALIFY row_number() OVER (PARTITION BY c1, c2 ORDER BY rn DESC) = 1")
def archive_in_order(spark, d):
    """Elites of all orders in order of their keys, by priority and month."""
    o = table(spark, d, "orders").where("o_orderkey is not null and o_totalprice is not null and o_orderdate is not null and o_custkey is not null")
    violation = F.greatest(F.lit(0.0), 20000 - F.col("o_totalprice"))
    rows = o.select(
        F.coalesce("o_orderpriority", F.lit("")).alias("c1"), F.month("o_orderdate").alias("c2"), F.col("o_orderkey").cast("string").alias("candidate"), "o_orderkey",
        (violation == 0).alias("feasible"), violation.alias("total_violation"), F.col("o_totalprice").alias("x"), (-(F.col("o_custkey") % 1000).cast("double")).alias("y"),
    )
    return ranking.archive_in_order(rows, "o_orderkey", ["c1", "c2"], ("x", "y"))


@query(
    _CAND_R + S.crowd() + ", c6 AS (SELECT *, round(crowding, 6) AS c FROM cro) SELECT candidate FROM c6 QUALIFY row_number() OVER (ORDER BY feasible DESC, CASE WHEN feasible THEN front ELSE 0 END, total_violation, c DESC, candidate) <= 20"
)
def survivors(spark, d):
    crowded = rounded(ranking.crowding(ranking.fronts(scored(spark, d))), "crowding")
    return ranking.survivors(crowded, 20).select("candidate")


# ---- hash tree, records --------------------------------------------------------------

_TEXT = "concat_ws('|', CAST(bar_idx AS VARCHAR), CAST(ts AS VARCHAR), CAST(CAST(round(close * 1000000) AS BIGINT) AS VARCHAR))"


@query(
    S.with_(
        f" l0 AS (SELECT symbol, bar_idx // 128 AS node, sha256(string_agg({_TEXT}, chr(10) ORDER BY bar_idx)) AS digest, count(*) AS n_rows FROM bars GROUP BY ALL)",
        *(f" l{k} AS (SELECT symbol, node // 8 AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM l{k - 1} WHERE (SELECT max(node) FROM l{k - 1}) > 0 GROUP BY symbol, node // 8)" for k in range(1, 9)),
    )
    + " UNION ALL ".join(f"SELECT symbol, {k} AS level, CAST(node AS BIGINT) AS node, digest, n_rows FROM l{k}" for k in range(9))
)
def content_hash_tree(spark, d):
    """The tree over all bars; chunks of 128 bars and 8 children, as given tables are short."""
    text = F.concat_ws("|", F.col("bar_idx").cast("string"), F.col("ts").cast("string"), F.round(F.col("close") * 1_000_000).cast("long").cast("string"))
    return hashtree.tree(bars(spark, d), ["symbol"], "bar_idx", text, 128, 8)


_LINKS = "SELECT event_id AS node, CASE WHEN event_id % 32 <> 0 THEN event_id - 1 END AS parent FROM events WHERE event_id IS NOT NULL"


def _links(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_id is not null").select(F.col("event_id").alias("node"), F.when(F.col("event_id") % 32 != 0, F.col("event_id") - 1).alias("parent"))


@query(f"SELECT '{{\"node\":' || CAST(node AS VARCHAR) || ',\"parent\":' || coalesce(CAST(parent AS VARCHAR), 'null') || '}}' AS record FROM ({_LINKS})")
def lineage_export(spark, d):
    return memory.lineage_records(_links(spark, d))


@query(f"SELECT {r('max(n) / sum(n)')} AS concentration FROM (SELECT count(*) AS n FROM events WHERE event_id IS NOT NULL GROUP BY event_id // 32)")
def lineage_concentration(spark, d):
    return rounded(memory.lineage_concentration(memory.lineage_roots(_links(spark, d))), "concentration")


@query("WITH k AS (SELECT event_type AS context, event_id % 10 AS d, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id IS NOT NULL) SELECT context, count(*) AS n, count(*) FILTER (d <> 0 AND value > 100) AS rewarded, CAST(sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS labels FROM k GROUP BY context")
def event_log_payloads(spark, d):
    """All evaluations written to an event log as one batch, twice, and read back."""
    log = memory.EventLog(spark, _scratch(spark, "log"))
    rows = evaluated(spark, d).select(F.lit("candidate_evaluated").alias("kind"), F.to_json(F.struct("context", "operator", "reward", "failure_labels")).alias("payload"))
    log.append_frame("evaluations", rows)
    log.append_frame("evaluations", rows)
    p = memory.payloads(log.events("candidate_evaluated"))
    return p.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count_if("reward").alias("rewarded"), F.sum(F.size("failure_labels")).cast("long").alias("labels"))


@query()
def operator_picks(spark, d):
    """The operator that a seeded draw from each posterior picks in each context."""
    got = memory.operator_outcomes(evaluated(spark, d))
    return posterior.picks(got, got.select("context"), got.select("operator"), seed=7)


@query(
    S.with_(S.FEATURES, S.ROUTER, S.RAW, S.DWELL)
    + """, k AS (SELECT symbol, median(atr_pct) AS vol, median(er) AS trend FROM ft GROUP BY symbol),
    m AS (SELECT symbol, regime FROM dwelt WHERE regime > 0 GROUP BY symbol, regime QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, regime) = 1)
    SELECT symbol, CASE WHEN vol IS NULL THEN 'anyfp' ELSE CASE WHEN vol > 0.01 THEN 'hivol' ELSE 'lovol' END || '_' || CASE WHEN trend > 0.3 THEN 'trendy' ELSE 'choppy' END END || '|r' || CAST(regime AS VARCHAR) AS context FROM k JOIN m USING (symbol)"""
)
def context_keys(spark, d):
    b = bars(spark, d)
    seen = regimes.fingerprint(b).join(regimes.dominant(regimes.dwell(regimes.raw_regimes(b, regimes.fit_router(b)))), "symbol")
    return seen.select("symbol", memory.context_key(F.col("atr_pct_median"), F.col("efficiency_median"), F.concat(F.lit("r"), F.col("regime").cast("string"))).alias("context"))


# ---- sources and sinks ---------------------------------------------------------------


def _exports(spark, d) -> str:
    """The bars of each series written as a JSON export."""
    path = _scratch(spark, "exports")
    b = bars(spark, d)
    sorted_ = F.array_sort(F.collect_list(F.struct("bar_idx", "ts", "open", "high", "low", "close", "volume")))  # the format has a series in one document
    docs = b.groupBy("symbol").agg(sorted_.alias("s")).select(
        "symbol", F.lit("H1").alias("period"), F.size("s").alias("bars"),
        F.transform("s", lambda x: ((x["ts"] - B.EPOCH_2000) / 60).cast("long")).alias("time"),
        *(F.col(f"s.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")),
    )
    docs.repartition(8, "symbol").write.json(path)
    return path


@query(S.with_() + "SELECT symbol, bar_idx, ts, open, high, low, close, volume FROM bars")
def bar_json_round_trip(spark, d):
    return B.read_bar_json(spark, _exports(spark, d), lines=True).drop("spread_points")


@query(S.with_() + "SELECT symbol, 'H1' AS period, CAST(count(*) AS INTEGER) AS n_bars FROM bars GROUP BY symbol")
def discover_exports(spark, d):
    return B.discover(spark, _exports(spark, d), lines=True)


@query(S.with_() + "SELECT symbol, bar_idx, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(make_timestamp(ts * 1000000), '%Y.%m.%d %H:%M') AS dotted FROM bars")
def bar_times(spark, d):
    return bars(spark, d).select("symbol", "bar_idx", B.iso_text("ts").alias("iso"), B.dotted_text("ts").alias("dotted"))


@query(S.with_(S.SIGNALS) + f"SELECT symbol, count(*) AS n, count(*) FILTER (entry_long) AS longs, count(*) FILTER (entry_short) AS shorts, {r('sum(coalesce(atr, 0))')} AS atr FROM sg GROUP BY symbol")
def signals_csv_round_trip(spark, d):
    path = _scratch(spark, "signals")
    s = signals(spark, d).withColumn("time", F.col("ts")).withColumn("atr", F.coalesce("atr", F.lit(0.0)))
    parity.write_signals(s, path, ["symbol"])
    back = parity.read_signals(spark, path, ["symbol"])
    return rounded(back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if("entry_long").alias("longs"), F.count_if("entry_short").alias("shorts"), F.sum("atr").alias("atr")), "atr")


@query()
def file_digests(spark, d):
    """SHA-256 of every file of the given tables."""
    return B.file_digests(spark, f"{d}/*.parquet").groupBy("digest").agg(F.count(F.lit(1)).alias("files"), F.max("length").alias("length"))


# ---- statistics ----------------------------------------------------------------------

#: The distribution by its series, its inverse by bisection.
_PHI = "(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * coalesce(list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(nullif(abs({x}), 0)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))), 0))"


@query(
    _BAT.replace("WITH ", "WITH RECURSIVE ")
    + f""", m AS (SELECT cand, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM battery GROUP BY cand),
    mo AS (SELECT cand, n, mean / sd AS s, avg(((ret - mean) / sd) ** 3) AS skew, avg(((ret - mean) / sd) ** 4) AS kurt FROM battery JOIN m USING (cand) GROUP BY cand, n, mean, sd),
    c AS (SELECT a.cand AS x, b.cand AS y, corr(a.ret, b.ret) AS r FROM battery a JOIN battery b USING (t) GROUP BY ALL),
    tr AS (SELECT greatest(1.0, least(count(DISTINCT x), count(DISTINCT x) * count(DISTINCT x) / sum(r * r))) AS t FROM c),
    want AS (SELECT 1 AS i, 1 - 1 / t AS p FROM tr UNION ALL SELECT 2, 1 - 1 / (t * exp(1)) FROM tr),
    bis AS (SELECT i, p, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS step FROM want
      UNION ALL SELECT i, p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, step + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {_PHI.format(x='((lo + hi) / 2)')} AS f FROM bis WHERE step < 60)),
    q AS (SELECT max(CASE WHEN i = 1 THEN lo END) AS a, max(CASE WHEN i = 2 THEN lo END) AS b FROM bis WHERE step = 60),
    em AS (SELECT sqrt(var_samp(s)) * ((1 - 0.5772156649015329) * any_value(a) + 0.5772156649015329 * any_value(b)) AS e FROM mo, q),
    z AS (SELECT cand, e, s * sqrt(n - 1) / sqrt(w) AS z0, (s - e) * sqrt(n - 1) / sqrt(w) AS z1 FROM (SELECT *, 1 - skew * s + (kurt - 1) / 4 * s * s AS w FROM mo), em)
    SELECT cand, {r(_PHI.format(x='z0'))} AS psr, {r('e')} AS expected_max, {r(_PHI.format(x='z1'))} AS dsr FROM z"""
)
def deflated_sharpe(spark, d):
    """Probabilistic and deflated ratio of every candidate, in one plan."""
    b = battery(spark, d)
    return rounded(stats.deflated_sharpes(stats.sharpe_moments(b), stats.effective_trials(b)), "psr", "expected_max", "dsr")


@query(
    _BAT
    + S.RESAMPLED.replace("SELECT sample, cand, ret FROM", "SELECT sample, pos, cand, ret FROM")
    + f""", one AS (SELECT sample, pos, avg(ret) AS ret FROM boot GROUP BY ALL), w AS (SELECT sample, pos, exp(sum(ln(1 + ret)) OVER (PARTITION BY sample ORDER BY pos)) AS e FROM one),
    dd AS (SELECT sample, max((p - e) / p) AS dd FROM (SELECT sample, e, greatest(1.0, max(e) OVER (PARTITION BY sample ORDER BY pos)) AS p FROM w) GROUP BY sample)
    SELECT {r('quantile_cont(dd, 0.05)')} AS p05, {r('quantile_cont(dd, 0.5)')} AS p50, {r('quantile_cont(dd, 0.95)')} AS p95 FROM dd"""
)
def drawdown_distribution(spark, d):
    """Maximal drawdowns of the resampled mean of all candidates."""
    returns, starts, n = _resampling(spark, d)
    one = stats.resampled(returns, starts, n, 10).groupBy("sample", "pos").agg(F.avg("ret").alias("ret"))
    return rounded(stats.drawdown_distribution(one), "p05", "p50", "p95")
