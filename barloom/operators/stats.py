"""Statistics on returns: moments, effective trials, overfitting, bootstrap, reality check, concentration.

A battery is a long table t (long), cand (string), ret (double).
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import StatisticsError
from barloom.functions.normal import cdf, inverse
from barloom.operators.ordinals import ntiles

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def sharpe_moments(battery: DataFrame) -> DataFrame:
    """cand, n, mean, sd (sample), sharpe, skew and kurt (moments over the sample sd, kurtosis not in excess)."""
    base = battery.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    first = base.groupBy("cand").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    z = (F.col("ret") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    second = base.join(first, "cand").groupBy("cand").agg(F.avg(z * z * z).alias("skew"), F.avg(z * z * z * z).alias("kurt"))
    return first.join(second, "cand").select("cand", "n", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).alias("sharpe"), "skew", "kurt")


def probabilistic_sharpe(sharpe: float | None, skew: float, kurt: float, n: int, benchmark: float = 0.0) -> float:
    """The probability that the true ratio exceeds the benchmark."""
    if n < 4:
        raise StatisticsError("needs four returns or more", n=n)
    if sharpe is None:
        return 0.0
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    return 0.0 if spread <= 0 else _NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_max_sharpe(trials: float, variance: float) -> float:
    """The best ratio to expect of so many trials without skill."""
    if trials < 1:
        raise StatisticsError("needs one trial or more", trials=trials)
    if trials <= 1 or variance <= 0:
        return 0.0
    a, b = _NORMAL.inv_cdf(1 - 1 / trials), _NORMAL.inv_cdf(1 - 1 / (trials * math.e))
    return math.sqrt(variance) * ((1 - EULER) * a + EULER * b)


def deflated_sharpe(row: dict, trials: float, variance: float) -> float:
    return probabilistic_sharpe(row["sharpe"], row["skew"], row["kurt"], row["n"], expected_max_sharpe(trials, variance))


def deflated_sharpes(moments: DataFrame, trials: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """cand, psr, expected_max, dsr of all candidates in one plan.

    `moments` as `sharpe_moments` gives them; `trials`: one row with
    n_effective.  The variance is that of the candidates' ratios.  A candidate
    without a ratio has probability 0, one with fewer than four returns none.
    """
    spread = moments.agg(F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("_variance"))
    one = trials.select(F.col("n_effective").cast("double").alias("_trials")).crossJoin(spread)  # one row
    t = F.col("_trials")
    best = F.sqrt("_variance") * ((1 - EULER) * inverse(1 - 1 / t) + EULER * inverse(1 - 1 / (t * math.e)))
    rows = moments.crossJoin(F.broadcast(one)).withColumn("expected_max", F.when((t > 1) & (F.col("_variance") > 0), best).otherwise(0.0))
    s = F.col("sharpe")
    wide = 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s

    def above(level: Column) -> Column:
        z = (s - level) * F.sqrt(F.col("n") - 1) / F.sqrt(wide)
        return F.when(F.col("n") >= 4, F.when(s.isNull() | (wide <= 0), 0.0).otherwise(cdf(z)))

    return rows.select("cand", above(F.lit(benchmark)).alias("psr"), "expected_max", above(F.col("expected_max")).alias("dsr"))


def effective_trials(battery: DataFrame) -> DataFrame:
    """n_candidates and n_effective: k * k over the sum of squared correlations, candidates without variance left out.

    This equals the participation ratio of the correlation matrix's spectrum
    and needs no decomposition: a pair join on t, with partial sums.
    """
    live = battery.groupBy("cand").agg(F.stddev_samp("ret").alias("sd")).where("sd > 0").select("cand")
    rows = battery.join(live, "cand")
    a, b = rows.select("t", F.col("cand").alias("a"), F.col("ret").alias("x")), rows.select("t", F.col("cand").alias("b"), F.col("ret").alias("y"))
    pairs = a.join(b, "t").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    k = F.count_distinct("a")
    return pairs.agg(k.alias("n_candidates"), F.greatest(F.lit(1.0), F.least(k.cast("double"), k * k / F.sum(F.col("r") * F.col("r")))).alias("n_effective"))


def cscv(battery: DataFrame, groups: int) -> DataFrame:
    """One row for each half of the groups taken as in-sample: combo, best (by Sharpe), omega, logit.

    Time is cut into equal groups; a broadcast table of some hundred combos
    says which groups are in-sample.
    """
    if groups < 2 or groups % 2:
        raise StatisticsError("needs an even number of groups", groups=groups)
    spark = battery.sparkSession
    combos = [(k, g, g in chosen) for k, chosen in enumerate(combinations(range(1, groups + 1), groups // 2)) for g in range(1, groups + 1)]
    table = F.broadcast(spark.createDataFrame(combos, "combo int, grp int, inside boolean"))
    times = ntiles(battery.select("t").distinct(), ["t"], groups, "grp")
    rows = battery.join(times, "t").join(table, "grp")
    mean, sd = F.avg("ret"), F.stddev_samp("ret")
    perf = rows.groupBy("combo", "inside", "cand").agg(F.when(sd > 0, mean / sd).otherwise(F.lit(float("-inf"))).alias("perf"))
    both = perf.where("inside").select("combo", "cand", F.col("perf").alias("is_perf")).join(perf.where("not inside").select("combo", "cand", F.col("perf").alias("oos")), ["combo", "cand"])
    name = F.dense_rank().over(W.partitionBy("combo").orderBy(F.desc("cand")))
    best = both.withColumn("_k", name).groupBy("combo").agg(F.max_by(F.struct("cand", "oos"), F.struct("is_perf", "_k")).alias("b"))
    ranked = both.join(best, "combo").groupBy("combo").agg(
        F.first("b.cand").alias("best"),
        F.count_if(F.col("oos") < F.col("b.oos")).alias("below"),
        F.count_if(F.col("oos") == F.col("b.oos")).alias("ties"),
        F.count(F.lit(1)).alias("n"),
    )
    omega = (F.col("below") + 0.5 * (F.col("ties") - 1) + 1) / (F.col("n") + 1)
    return ranked.select("combo", "best", omega.alias("omega")).withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega"))))


def overfitting_probability(combos: DataFrame) -> DataFrame:
    return combos.agg(F.count(F.lit(1)).alias("n_combos"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.median("logit").alias("median_logit"))


def block_starts(spark: SparkSession, n: int, block: int, samples: int, seed: int) -> DataFrame:
    """sample, block_no, start of a circular block bootstrap, drawn on the driver."""
    if not 1 <= block <= n:
        raise StatisticsError("bad block length", block=block, n=n)
    rng = np.random.default_rng(seed)
    per = -(-n // block)
    starts = rng.integers(0, n, size=(samples, per))
    return spark.createDataFrame([(s, b, int(starts[s, b])) for s in range(samples) for b in range(per)], "sample int, block_no int, start long")


def resampled(returns: DataFrame, starts: DataFrame, n: int, block: int) -> DataFrame:
    """sample, pos and the columns of `returns` (t from 0): the bootstrap series, n rows for each sample."""
    at = starts.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    at = at.select("sample", (F.col("block_no") * block + F.col("offset")).alias("pos"), ((F.col("start") + F.col("offset")) % n).alias("t")).where(F.col("pos") < n)
    return at.join(returns, "t")


def sharpe_confidence(samples: DataFrame) -> DataFrame:
    each = samples.groupBy("sample").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"))
    p = F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return each.agg(p.alias("p")).select(*(F.get("p", F.lit(k)).alias(c) for k, c in enumerate(("p05", "p50", "p95"))))


def drawdown_distribution(samples: DataFrame) -> DataFrame:
    """Percentiles of the maximal drawdown of compounded samples."""
    w = W.partitionBy("sample").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    path = samples.withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(w)))
    path = path.withColumn("_p", F.greatest(F.max("_e").over(w), F.lit(1.0)))
    each = path.groupBy("sample").agg(F.max((F.col("_p") - F.col("_e")) / F.col("_p")).alias("dd"))
    p = F.percentile("dd", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return each.agg(p.alias("p")).select(*(F.get("p", F.lit(k)).alias(c) for k, c in enumerate(("p05", "p50", "p95"))))


def reality_check(battery: DataFrame, starts: DataFrame, n: int, block: int) -> DataFrame:
    """observed (best mean times root n), p_value against the recentred bootstrap."""
    means = battery.groupBy("cand").agg(F.avg("ret").alias("mean"))
    observed = means.agg((F.max("mean") * math.sqrt(n)).alias("observed"))
    boot = resampled(battery, starts, n, block).groupBy("sample", "cand").agg(F.avg("ret").alias("m")).join(means, "cand")
    best = boot.groupBy("sample").agg((F.max(F.col("m") - F.col("mean")) * math.sqrt(n)).alias("stat"))
    return best.join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), ((F.count_if(F.col("stat") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def return_concentration(trades: DataFrame, by: str = "symbol", pnl: str = "pnl") -> DataFrame:
    """For each run: the share of the best and the three best winners, their Herfindahl index, and the net result."""
    rows = trades.withColumn("_win", F.greatest(F.col(pnl), F.lit(0.0))).withColumn("_nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc(pnl))))
    rows = rows.withColumn("_all", F.sum("_win").over(W.partitionBy(by)))
    share = F.col("_win") / F.nullif("_all", F.lit(0.0))
    return rows.groupBy(by).agg(
        F.coalesce(F.sum(F.when(F.col("_nth") <= 1, share)), F.lit(0.0)).alias("top1_share"),
        F.coalesce(F.sum(F.when(F.col("_nth") <= 3, share)), F.lit(0.0)).alias("top3_share"),
        F.coalesce(F.sum(share * share), F.lit(0.0)).alias("hhi"),
        F.sum(pnl).alias("net"),
    )
