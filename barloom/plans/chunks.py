"""Chunks of a series, so that neither a window nor a recursion needs a task for a whole series.

A series is cut by bar index into chunks of `size` bars.  A window of lookback
h sees a chunk and its halo, copies of the h bars before it; copies are left
out again when the windows are done.

A recursive average is a composition of affine maps ``e -> e + alpha (x - e)``.
Within a chunk of r known values it is ``v + fade^r e`` with ``fade = 1 -
alpha`` and ``v = alpha * sum(x_j fade^(r - r_j))``, a running sum of weighted
values.  So each chunk is one map (number of known values, v at its end).  The
maps of a series, a row for each chunk, are composed by running sums of the
same kind, and give the state in which each chunk begins; the second pass adds
it to the rows.  All is built-in windows and aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.ops import CHUNK

SIZE = 8192
#: Weights go up to e to this power.
_MOST_POWER = 550.0
#: A state that has faded by e to minus this power is nothing beside any value.
_FADED = 300.0


def chunk_of(size: int) -> Column:
    return F.floor(F.col("bar_idx") / size).cast("long")


def with_halo(df: DataFrame, size: int, halo: int) -> DataFrame:
    """A row for each chunk that needs the bar."""
    return df.withColumn(CHUNK, F.explode(F.sequence(chunk_of(size), F.floor((F.col("bar_idx") + halo) / size).cast("long"))) if halo else chunk_of(size))


def without_halo(df: DataFrame, size: int) -> DataFrame:
    return df.where(F.col(CHUNK) == chunk_of(size))


def longest_chunk(periods: list[int]) -> int:
    """The longest chunk whose weights fit a double, for recursive averages of these periods."""
    return min([SIZE, *(int(_MOST_POWER / _decay(p)) for p in periods if p > 1)])


def _decay(period: int) -> float:
    return math.log((period + 1) / (period - 1))


def _fade(period: int, n: Column) -> Column:
    return F.pow(F.lit((period - 1) / (period + 1)), n)


def _known(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))


def add_averages(df: DataFrame, targets: list[tuple[str, str, int]]) -> DataFrame:
    """Recursive averages (input column, output column, period) of rows that are cut into chunks."""
    df = df.withColumns({out: F.when(_known(x), F.col(x)) for x, out, p in targets if p == 1})
    targets = [t for t in targets if t[2] > 1]
    if not targets:
        return df
    base = df.columns
    inputs = {x: f"_n{k}" for k, x in enumerate(dict.fromkeys(x for x, _, _ in targets))}
    own = W.partitionBy("symbol", CHUNK).orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns({n: F.count(F.when(_known(x), 1)).over(own) for x, n in inputs.items()})
    local = {}
    for k, (x, _, p) in enumerate(targets):
        n = F.col(inputs[x])
        local[f"_v{k}"] = _fade(p, n) * F.sum(F.when(_known(x), F.col(x) * F.pow(F.lit((p + 1) / (p - 1)), n))).over(own) * (2.0 / (p + 1))
    rows = rows.withColumns(local)
    maps = rows.groupBy("symbol", CHUNK).agg(
        *(F.max(n).alias(n) for n in inputs.values()),
        *(F.min_by(F.col(x), F.when(_known(x), F.col("bar_idx"))).alias(f"_f{n}") for x, n in inputs.items()),
        *(F.coalesce(F.max_by(f"_v{k}", "bar_idx"), F.lit(0.0)).alias(f"_v{k}") for k in range(len(targets))),
    )
    begins = _begins(maps, targets, inputs)
    joined = rows.join(begins, rows["symbol"].eqNullSafe(begins["_symbol"]) & (rows[CHUNK] == begins["_of"]), "left")
    out = {o: F.when(_known(x), F.col(f"_v{k}") + _fade(p, F.col(inputs[x])) * F.col(f"_e{k}")) for k, (x, o, p) in enumerate(targets)}
    return joined.select(*base, *(c.alias(o) for o, c in out.items()))


def _begins(maps: DataFrame, targets: list[tuple[str, str, int]], inputs: dict[str, str]) -> DataFrame:
    """_symbol, _of (chunk), _e0 ...: the state in which each chunk begins.

    After chunk k the state is the sum of ``v_j fade^(M_k - M_j)`` over j <= k, M
    the running number of known values.  It is summed within stretches over
    which the fade is e^-300 at most, to keep the weights in range; of earlier
    stretches only the last state of the one before is not faded to nothing.
    """
    series = W.partitionBy("symbol").orderBy(CHUNK)
    until = series.rowsBetween(W.unboundedPreceding, 0)
    every = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    maps = maps.withColumns({n: F.sum(n).over(until) for n in inputs.values()} | {f"_f{n}": F.first(f"_f{n}", ignorenulls=True).over(every) for n in inputs.values()})
    for k, (x, _, p) in enumerate(targets):
        c, m, first = _decay(p), F.col(inputs[x]).cast("double"), F.col(f"_f{inputs[x]}")
        maps = maps.withColumn("_s", F.floor(m * c / _FADED))
        past = m * c - F.col("_s") * _FADED
        within = W.partitionBy("symbol", "_s").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, 0)
        here = (F.sum(F.col(f"_v{k}") * F.exp(past)).over(within) + F.when(F.col("_s") == 0, first).otherwise(0.0)) * F.exp(-past)
        maps = maps.withColumn("_l", here)
        before = W.partitionBy("symbol").orderBy("_s").rangeBetween(-1, -1)
        maps = maps.withColumn("_p", F.max_by(F.struct(m.alias("m"), F.col("_l").alias("l")), CHUNK).over(before))
        maps = maps.withColumn(f"_t{k}", F.col("_l") + F.coalesce(F.exp(-c * (m - F.col("_p.m"))) * F.col("_p.l"), F.lit(0.0)))
    entering = [F.coalesce(F.lag(f"_t{k}").over(series), F.col(f"_f{inputs[x]}")).alias(f"_e{k}") for k, (x, _, _) in enumerate(targets)]
    return maps.select(F.col("symbol").alias("_symbol"), F.col(CHUNK).alias("_of"), *entering)
