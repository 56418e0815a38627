"""Fingerprints and causal regime labels, by windows and grouped percentiles alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import RouterError
from barloom.functions.expr import CLOSE, n
from barloom.plans.compiler import evaluate
from barloom.sources.bars import series

#: The regimes by label.
REGIMES = {0: "UNKNOWN", 1: "TREND_HIGH_VOL", 2: "TREND_LOW_VOL", 3: "RANGE_HIGH_VOL", 4: "RANGE_LOW_VOL"}


def features(bars: DataFrame, er_period: int = 24, atr_period: int = 14) -> DataFrame:
    """Bars with er, atr, atr_pct and ret."""
    out = evaluate(bars, {"er": n("efficiency_ratio", CLOSE, period=er_period), "atr": n("atr", period=atr_period), "ret": n("ret", CLOSE, period=1)})
    return out.withColumn("atr_pct", F.when(F.col("close") != 0, F.col("atr") / F.col("close")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def fingerprint(bars: DataFrame, er_period: int = 24, atr_period: int = 14) -> DataFrame:
    """One row of descriptors for each symbol, from the bars given and no others."""
    w = series()
    before = F.lag("close").over(w)
    gap = F.abs(F.col("open") - before)
    rows = features(bars, er_period, atr_period).withColumns({"abs_ret": F.abs("ret"), "jump": F.when(gap.isNotNull() & (F.col("atr") > 0), (gap > F.col("atr")).cast("double"))})
    rows = rows.withColumn("ret_before", F.last("ret", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("ret_before", F.when(F.col("ret").isNotNull(), F.col("ret_before")))
    q = lambda c, p: F.percentile(c, F.lit(p))
    got = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.median("atr_pct").alias("atr_pct_median"),
        (q("atr_pct", 0.75) - q("atr_pct", 0.25)).alias("_iqr"),
        F.median("er").alias("efficiency_median"),
        q("er", 0.9).alias("efficiency_p90"),
        F.median("abs_ret").alias("abs_ret_median"),
        q("abs_ret", 0.99).alias("_p99"),
        F.avg("jump").alias("gap_over_atr_freq"),
        F.corr(F.when(F.col("ret_before").isNotNull(), F.col("ret")), "ret_before").alias("ret_autocorr_lag1"),
    )
    return got.select(
        "symbol",
        "n_bars",
        "atr_pct_median",
        _ratio(F.col("_iqr"), F.col("atr_pct_median")).alias("atr_pct_iqr_rel"),
        "efficiency_median",
        "efficiency_p90",
        "abs_ret_median",
        _ratio(F.col("_p99"), F.col("abs_ret_median")).alias("ret_tail_ratio"),
        "gap_over_atr_freq",
        "ret_autocorr_lag1",
    )


def fit_router(train: DataFrame, min_dwell: int = 6, er_period: int = 24, atr_period: int = 14) -> DataFrame:
    """Thresholds of each symbol from training bars; null where there are fewer than 10 * min_dwell valid rows."""
    got = features(train, er_period, atr_period).groupBy("symbol").agg(F.median("er").alias("er"), F.median("atr_pct").alias("vol"), F.count("er").alias("n_er"), F.count("atr_pct").alias("n_vol"))
    enough = F.least("n_er", "n_vol") >= 10 * min_dwell
    return got.select("symbol", F.when(enough, F.col("er")).alias("er_threshold"), F.when(enough, F.col("vol")).alias("vol_threshold"))


def require_fitted(router: DataFrame) -> None:
    short = router.where("er_threshold is null").head()
    if short is not None:
        raise RouterError("too few training bars for thresholds", symbol=short["symbol"])


def raw_regimes(bars: DataFrame, router: DataFrame, er_period: int = 24, atr_period: int = 14) -> DataFrame:
    """symbol, bar_idx, raw (0 where a feature is missing)."""
    rows = features(bars, er_period, atr_period).join(router, "symbol")
    trend, high = F.col("er") > F.col("er_threshold"), F.col("atr_pct") > F.col("vol_threshold")
    label = F.when(F.col("er").isNull() | F.col("atr_pct").isNull() | F.col("er_threshold").isNull(), 0).when(trend & high, 1).when(trend, 2).when(high, 3).otherwise(4)
    return rows.select("symbol", "bar_idx", label.cast("int").alias("raw"))


def dwell(labels: DataFrame, min_dwell: int = 6) -> DataFrame:
    """Adds regime: the last label that held for min_dwell bars in a row; no bar's label depends on later ones.

    A run's position is counted within its island; a label commits where the
    position reaches the dwell, and the last commitment is carried on.
    """
    w = series()
    runs = labels.withColumn("_new", F.coalesce((F.col("raw") != F.lag("raw").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("_pos", F.row_number().over(W.partitionBy("symbol", "_run").orderBy("bar_idx")))
    commit = F.when((F.col("_pos") >= min_dwell) & (F.col("raw") != 0), F.col("raw"))
    regime = F.coalesce(F.last(commit, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return runs.withColumn("regime", regime.cast("int")).drop("_new", "_run", "_pos")


def dominant(labels: DataFrame) -> DataFrame:
    """The commonest positive regime of each symbol, the smallest of equals."""
    counts = labels.where("regime > 0").groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"))
    best = counts.groupBy("symbol").agg(F.max_by(F.struct("regime", "bars"), F.struct("bars", -F.col("regime"))).alias("b"))
    return best.select("symbol", "b.regime", "b.bars")
