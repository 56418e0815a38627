"""Seeded draws from beta posteriors, and the operator that a draw picks in each context.

A draw is the inverse of the beta distribution at a number between 0 and 1 that
is a hash of the row's names and a seed: it depends neither on partitions nor
on other rows.  The inverse is found by bisection of the regularised
incomplete beta function, a continued fraction, for a batch of rows at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import ship

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, value = np.ones_like(x), d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return value


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.asarray(v, dtype=np.float64) for v in (a, b, x))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp((_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)).astype(np.float64) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)
    tail = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, tail, 1 - tail)))


def beta_inverse(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(u)), np.ones(len(u))
    for _ in range(60):
        middle = (low + high) / 2
        below = beta_cdf(a, b, middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def draws(outcomes: DataFrame, keys: list[str], seed: int, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Adds draw, from the posterior of `successes` among `trials` under a beta prior; one for each row of different `keys`."""
    ship(outcomes.sparkSession)
    u = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = outcomes.withColumn("draw", u)
    schema = rows.schema
    at = [rows.columns.index(c) for c in ("successes", "trials", "draw")]

    def run(batches):
        for batch in batches:
            won, tried, u = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in at)
            got = beta_inverse(prior[0] + won, prior[1] + tried - won, u) if batch.num_rows else u
            yield batch.set_column(at[2], batch.schema.field(at[2]), pa.array(got))

    return rows.mapInArrow(run, schema)


def picks(outcomes: DataFrame, contexts: DataFrame, operators: DataFrame, seed: int, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """context, operator, draw: the operator with the largest draw in each context; ties to the first name.

    `operators` are the few that may be picked (a fixed list of names); one without outcomes in a context draws from the prior.
    """
    every = contexts.select("context").distinct().crossJoin(F.broadcast(operators.select("operator").distinct()))
    known = every.join(outcomes.select("context", "operator", "successes", "trials"), ["context", "operator"], "left").fillna(0, ["successes", "trials"])
    drawn = draws(known, ["context", "operator"], seed, prior)
    best = F.min_by(F.struct("operator", "draw"), F.struct((-F.col("draw")).alias("d"), "operator"))
    return drawn.groupBy("context").agg(best.alias("b")).select("context", "b.operator", "b.draw")
