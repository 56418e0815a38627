"""Data quality: twelve checks in one aggregation per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.errors import QualityError
from barloom.sources.bars import series

#: The checks and their severity, in order.
CHECKS = {
    "non_empty": "error",
    "monotonic_time": "error",
    "no_duplicate_timestamps": "error",
    "timeframe_alignment": "error",
    "finite_values": "error",
    "ohlc_invariants": "error",
    "positive_prices": "error",
    "volume_non_negative": "error",
    "gap_census": "warning",
    "zero_volume_bars": "warning",
    "spread_series_informative": "warning",
    "price_quantization": "warning",
}
_VALUES = ("open", "high", "low", "close", "volume")


def finite(c: str):
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _finite_row():
    out = finite(_VALUES[0])
    for c in _VALUES[1:]:
        out &= finite(c)
    return out


def quality_counts(bars: DataFrame, seconds: int, tick: float) -> DataFrame:
    """For each symbol the number of offending bars of each check, and what the gaps miss."""
    if "spread_points" not in bars.columns:
        bars = bars.withColumn("spread_points", F.lit(None).cast("double"))
    w = series()
    rows = bars.withColumns({"_dt": F.col("ts") - F.lag("ts").over(w), "_first": F.first("ts").over(w), "_ok": _finite_row()})
    bad = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    broken = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    coarse = F.lit(tick) / F.greatest("close", F.lit(tick)) > 0.01
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        bad(F.col("_dt") < 0).alias("backwards"),
        bad(F.col("_dt") == 0).alias("duplicates"),
        bad((F.col("ts") - F.col("_first")) % seconds != 0).alias("misaligned"),
        bad(~F.col("_ok")).alias("not_finite"),
        bad(broken).alias("broken_ohlc"),
        bad(F.least("open", "high", "low", "close") <= 0).alias("not_positive"),
        bad(F.col("volume") < 0).alias("negative_volume"),
        bad(F.col("_dt") > seconds).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("_dt") > seconds, F.floor(F.col("_dt") / seconds) - 1)), F.lit(0)).cast("long").alias("missing_bars"),
        bad(F.col("volume") == 0).alias("zero_volume"),
        F.coalesce(F.min("spread_points") != F.max("spread_points"), F.lit(False)).alias("spread_varies"),
        bad(coarse).alias("coarse_ticks"),
        F.min(F.when(~coarse, F.col("bar_idx"))).alias("first_fine_bar"),
    )


def quality_report(bars: DataFrame, seconds: int, tick: float) -> DataFrame:
    """symbol, check, severity, passed, offending for each check."""
    c = F.col
    unusable = c("not_finite") > 0
    cases = {
        "non_empty": F.lit(0),
        "monotonic_time": c("backwards"),
        "no_duplicate_timestamps": c("duplicates"),
        "timeframe_alignment": c("misaligned"),
        "finite_values": c("not_finite"),
        "ohlc_invariants": F.when(unusable, c("not_finite")).otherwise(c("broken_ohlc")),
        "positive_prices": F.when(unusable, c("not_finite")).otherwise(c("not_positive")),
        "volume_non_negative": F.when(unusable, c("not_finite")).otherwise(c("negative_volume")),
        "gap_census": c("gaps"),
        "zero_volume_bars": c("zero_volume"),
        "spread_series_informative": F.when(c("spread_varies"), 0).otherwise(1),
        "price_quantization": c("coarse_ticks"),
    }
    items = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(CHECKS[k]).alias("severity"), v.cast("long").alias("offending")) for k, v in cases.items()))
    rows = quality_counts(bars, seconds, tick).select("symbol", F.explode(items).alias("i")).select("symbol", "i.*")
    return rows.withColumn("passed", F.col("offending") == 0)


def gap_census(bars: DataFrame, seconds: int, most: int = 20) -> DataFrame:
    """The first gaps of each symbol: bar_idx after the gap and how many bars are missing."""
    w = series()
    gaps = bars.withColumn("_dt", F.col("ts") - F.lag("ts").over(w)).where(F.col("_dt") > seconds)
    gaps = gaps.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return gaps.select("symbol", F.col("nth").cast("int").alias("nth"), "bar_idx", (F.floor(F.col("_dt") / seconds) - 1).cast("long").alias("missing"))


def require_quality(bars: DataFrame, seconds: int, tick: float) -> None:
    """Raises if any check of severity error fails."""
    failed = quality_report(bars, seconds, tick).where("severity = 'error' and not passed").limit(5).collect()
    if failed:
        raise QualityError("quality checks failed", checks=[(r["symbol"], r["check"], r["offending"]) for r in failed])
    if bars.isEmpty():
        raise QualityError("no bars")
