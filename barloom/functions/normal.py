"""The normal distribution and its inverse as columns.

Both are rational approximations in built-in arithmetic: the distribution
after Hart, with a continued fraction in the tails (absolute error below 1e-15,
of a value in the lower tail below 1e-12), the inverse after Acklam with one step
of Halley's method (relative error below 1e-12).  Null and NaN stay what they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hart's approximation of the tail, highest power first.
_TAIL = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Acklam's approximation of the inverse in the middle and in the tails, highest power first.
_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_ENDS = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ENDS_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_EDGE = 0.02425
#: Steps of the continued fraction of the tail beyond 4 standard deviations.
_DEPTH = 24


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda value, c: value * x + c, coefficients[1:], F.lit(coefficients[0]))


def _upper(z: Column) -> Column:
    """The probability above z >= 0."""
    near = _polynomial(z, _TAIL) / _polynomial(z, _TAIL_UNDER)
    far = 1 / (reduce(lambda deeper, k: z + k / deeper, range(_DEPTH, 0, -1), z) * math.sqrt(2 * math.pi))
    return F.exp(-z * z / 2) * F.when(z < 4, near).otherwise(far)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cdf(x: Column) -> Column:
    """The probability of values up to x."""

    def of(x: Column) -> Column:
        upper = F.when(F.abs(x) > 38, 0.0).otherwise(_upper(F.abs(x)))
        return F.when(F.isnan(x), x).otherwise(_let(upper, lambda u: F.when(x > 0, 1 - u).otherwise(u)))

    return _let(x, of)


def inverse(p: Column) -> Column:
    """The x up to which values have probability p; infinite at 0 and 1, null outside."""

    def first(p: Column) -> Column:
        tail = _let(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), lambda t: _polynomial(t, _ENDS) / _polynomial(t, _ENDS_UNDER))
        middle = _let(p - 0.5, lambda q: _let(q * q, lambda r: _polynomial(r, _MIDDLE) * q / _polynomial(r, _MIDDLE_UNDER)))
        return F.when(p < _EDGE, tail).when(p > 1 - _EDGE, -tail).otherwise(middle)

    def exact(p: Column, x: Column) -> Column:
        off = F.when(x > 0, 1 - p - _upper(x)).otherwise(_upper(-x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return _let(off, lambda step: x - step / (1 + x * step / 2))

    def of(p: Column) -> Column:
        inner = _let(first(p), lambda x: exact(p, x))
        return F.when((p > 0) & (p < 1), inner).when(p == 0, float("-inf")).when(p == 1, float("inf"))

    return _let(p, of)
