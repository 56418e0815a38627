"""The operators of the expression language as Spark columns.

Missing values are null.  Comparisons are two-valued: a missing side makes them
false, so that ``not`` of one is true.  A window gives a value only once its
frame is full and has no missing value.  No frame looks ahead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import CompileError, UnitError
from barloom.functions.expr import COMPARABLE, NUMERIC, SIGNED, Node, Unit

#: The chunk of a series that a row belongs to, or is a copy for.
CHUNK = "_chunk"


@dataclass(frozen=True)
class Op:
    """What is known of an operator: arity (None: two or more), least period, cost, units, lookback and its column."""

    arity: int | None
    least_period: int | None
    cost: int
    units: Callable[[Node, list[Unit]], Unit]
    lookback: Callable[[int], int]
    build: Callable[[Node, list[Column]], Column] | None


OPS: dict[str, Op] = {}


def register(name: str, op: Op) -> None:
    if name in OPS:
        raise CompileError("operator exists already", op=name)
    OPS[name] = op


def get(name: str) -> Op:
    if name not in OPS:
        raise CompileError("unknown operator", op=name)
    return OPS[name]


def _want(node: Node, units: list[Unit], allowed, what: str) -> None:
    for u in units:
        if u not in allowed:
            raise UnitError(f"{node.op} takes {what}", got=u.value)


def fixed(out: Unit, allowed=NUMERIC, what: str = "numbers"):
    def rule(node: Node, units: list[Unit]) -> Unit:
        _want(node, units, allowed, what)
        return out

    return rule


def same(allowed=NUMERIC, what: str = "numbers"):
    def rule(node: Node, units: list[Unit]) -> Unit:
        _want(node, units, allowed, what)
        return units[0]

    return rule


def _equal(node: Node, units: list[Unit]) -> None:
    if len(set(units)) > 1:
        raise UnitError(f"{node.op} takes one unit on both sides", got=[u.value for u in units])


def _linear(node: Node, units: list[Unit]) -> Unit:
    _want(node, units, NUMERIC, "numbers")
    _equal(node, units)
    return Unit.UNSCALED


def _compare(node: Node, units: list[Unit]) -> Unit:
    _want(node, units, COMPARABLE, "values that have a scale")
    _equal(node, units)
    return Unit.BOOL


def _spread_unit(node: Node, units: list[Unit]) -> Unit:
    _want(node, units, NUMERIC, "numbers")
    return Unit.VOLATILITY if units[0] in (Unit.PRICE, Unit.RETURN) else Unit.UNSCALED


def _constant_unit(node: Node, units: list[Unit]) -> Unit:
    if node.value is None or node.unit is None:
        raise CompileError("a constant needs a value and a unit")
    try:
        unit = Unit(node.unit)
    except ValueError:
        raise UnitError("unknown unit", unit=node.unit) from None
    if unit in (Unit.BOOL, Unit.UNSCALED):
        raise UnitError("no constants of this unit", unit=node.unit)
    return unit


def series():
    """The window of one chunk of a series in order."""
    return W.partitionBy("symbol", CHUNK).orderBy("bar_idx")


def frame(p: int):
    return series().rowsBetween(-(p - 1), 0)


def full(x: Column, p: int) -> Column:
    return F.count(x).over(frame(p)) == p


def whole(x: Column, p: int, value: Column) -> Column:
    return F.when(full(x, p), value)


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def true_range() -> Column:
    before = lag(F.col("close"))
    first = F.col("high") - F.col("low")
    return F.when(before.isNull(), first).otherwise(F.greatest(first, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def _zscore(node: Node, c: list[Column]) -> Column:
    x, f = c[0], frame(node.period)
    sd = F.stddev_pop(x).over(f)
    return F.when(full(x, node.period) & (sd > 0), (x - F.avg(x).over(f)) / sd)


def _rank(node: Node, c: list[Column]) -> Column:
    x, p = c[0], node.period
    below = F.aggregate(F.collect_list(x).over(frame(p)), F.lit(0), lambda n, v: n + F.when(v <= x, 1).otherwise(0))
    return whole(x, p, below / p)


def _ret(node: Node, c: list[Column]) -> Column:
    before = lag(c[0], node.period)
    return F.when(before != 0, c[0] / before - 1)


def _efficiency(node: Node, c: list[Column]) -> Column:
    x, p = c[0], node.period
    step = F.abs(x - lag(x))
    path = F.sum(step).over(frame(p))
    return F.when((F.count(step).over(frame(p)) == p) & (path > 0), F.abs(x - lag(x, p)) / path)


def _rsi(node: Node, c: list[Column]) -> Column:
    x, p = c[0], node.period
    d = x - lag(x)
    up, down = F.avg(F.greatest(d, F.lit(0.0))).over(frame(p)), F.avg(F.greatest(-d, F.lit(0.0))).over(frame(p))
    return F.when(F.count(d).over(frame(p)) == p, F.when(up + down > 0, 100 * up / (up + down)).otherwise(50.0))


def _chop(node: Node, _: list[Column]) -> Column:
    p = node.period
    total = F.sum(true_range()).over(frame(p))
    wide = F.max("high").over(frame(p)) - F.min("low").over(frame(p))
    return F.when((F.count(true_range()).over(frame(p)) == p) & (wide > 0) & (total > 0), F.log10(total / wide) / F.log10(F.lit(float(p))))


def _cross(above: bool):
    def build(_: Node, c: list[Column]) -> Column:
        a, b = c if above else (c[1], c[0])
        return F.coalesce((lag(a) <= lag(b)) & (a > b), F.lit(False))

    return build


def _window(value: Callable[[Column, int], Column]):
    return lambda node, c: whole(c[0], node.period, value(c[0], node.period))


_zero = lambda p: 0
_less = lambda p: p - 1
_same = lambda p: p
for _name in ("close", "open", "high", "low"):
    register(_name, Op(0, None, 1, lambda n, u: Unit.PRICE, _zero, lambda n, c: F.col(n.op)))
register("volume", Op(0, None, 1, lambda n, u: Unit.VOLUME, _zero, lambda n, c: F.col("volume")))
register("constant", Op(0, None, 0, _constant_unit, _zero, lambda n, c: F.lit(n.value)))
register("abs", Op(1, None, 1, same(SIGNED, "signed values"), _zero, lambda n, c: F.abs(c[0])))
register("neg", Op(1, None, 1, same(SIGNED, "signed values"), _zero, lambda n, c: -c[0]))
register("add", Op(2, None, 1, _linear, _zero, lambda n, c: c[0] + c[1]))
register("sub", Op(2, None, 1, _linear, _zero, lambda n, c: c[0] - c[1]))
register("gt", Op(2, None, 1, _compare, _zero, lambda n, c: F.coalesce(c[0] > c[1], F.lit(False))))
register("lt", Op(2, None, 1, _compare, _zero, lambda n, c: F.coalesce(c[0] < c[1], F.lit(False))))
register("and", Op(None, None, 1, fixed(Unit.BOOL, {Unit.BOOL}, "conditions"), _zero, lambda n, c: reduce(lambda a, b: a & b, c)))
register("or", Op(None, None, 1, fixed(Unit.BOOL, {Unit.BOOL}, "conditions"), _zero, lambda n, c: reduce(lambda a, b: a | b, c)))
register("not", Op(1, None, 1, fixed(Unit.BOOL, {Unit.BOOL}, "conditions"), _zero, lambda n, c: ~c[0]))
register("cross_above", Op(2, None, 2, _compare, lambda p: 1, _cross(True)))
register("cross_below", Op(2, None, 2, _compare, lambda p: 1, _cross(False)))
register("sma", Op(1, 1, 3, same(), _less, _window(lambda x, p: F.avg(x).over(frame(p)))))
register("highest", Op(1, 1, 3, same(), _less, _window(lambda x, p: F.max(x).over(frame(p)))))
register("lowest", Op(1, 1, 3, same(), _less, _window(lambda x, p: F.min(x).over(frame(p)))))
register("stdev", Op(1, 2, 3, _spread_unit, _less, _window(lambda x, p: F.stddev_pop(x).over(frame(p)))))
register("zscore", Op(1, 2, 3, fixed(Unit.ZSCORE), _less, _zscore))
register("rank", Op(1, 2, 3, fixed(Unit.OSC_0_1), _less, _rank))
register("delta", Op(1, 1, 2, fixed(Unit.UNSCALED), _same, lambda n, c: c[0] - lag(c[0], n.period)))
register("ret", Op(1, 1, 2, fixed(Unit.RETURN, {Unit.PRICE}, "prices"), _same, _ret))
register("efficiency_ratio", Op(1, 2, 3, fixed(Unit.OSC_0_1, {Unit.PRICE}, "prices"), _same, _efficiency))
register("rsi", Op(1, 2, 4, fixed(Unit.OSC_0_100), _same, _rsi))
register("atr", Op(0, 1, 4, lambda n, u: Unit.VOLATILITY, _less, lambda n, c: whole(true_range(), n.period, F.avg(true_range()).over(frame(n.period)))))
register("chop", Op(0, 2, 4, lambda n, u: Unit.OSC_0_1, _less, _chop))
#: Recursive: built by the compiler as a pass over the sorted series.
register("ema", Op(1, 1, 3, same(), _zero, None))
