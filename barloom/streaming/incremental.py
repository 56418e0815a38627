"""The expression language one bar at a time.

Each node of an expression has a small state; a bar goes in, a value comes
out.  The same states serve Structured Streaming (one state for each series)
and a pass over a sorted batch, with which the window plans are compared.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.expr import Node, Unit
from barloom.plans.compiler import unit_of
from barloom.session import ship

BAR = ("open", "high", "low", "close", "volume")


def _window(fn):
    def step(state, node, bar, args):
        w = state.setdefault(node, deque(maxlen=node.period))
        w.append(args[0])
        return fn(list(w)) if len(w) == node.period and None not in w else None

    return step


def _zscore(w):
    mean = sum(w) / len(w)
    sd = math.sqrt(sum((x - mean) ** 2 for x in w) / len(w))
    return (w[-1] - mean) / sd if sd > 0 else None


def _stdev(w):
    mean = sum(w) / len(w)
    return math.sqrt(sum((x - mean) ** 2 for x in w) / len(w))


def _longer(fn):
    """A window of one value more than the period."""

    def step(state, node, bar, args):
        w = state.setdefault(node, deque(maxlen=node.period + 1))
        w.append(args[0])
        return fn(list(w)) if len(w) == node.period + 1 else None

    return step


def _delta(w):
    return None if w[0] is None or w[-1] is None else w[-1] - w[0]


def _ret(w):
    return None if not w[0] or w[-1] is None else w[-1] / w[0] - 1


def _efficiency(w):
    if None in w:
        return None
    path = sum(abs(b - a) for a, b in zip(w, w[1:]))
    return abs(w[-1] - w[0]) / path if path > 0 else None


def _rsi(w):
    if None in w:
        return None
    up = sum(max(b - a, 0.0) for a, b in zip(w, w[1:]))
    down = sum(max(a - b, 0.0) for a, b in zip(w, w[1:]))
    return 100 * up / (up + down) if up + down > 0 else 50.0


def _range(state, node, bar):
    before = state.get((node, "close"))
    state[(node, "close")] = bar["close"]
    first = bar["high"] - bar["low"]
    return first if before is None else max(first, abs(bar["high"] - before), abs(bar["low"] - before))


def _atr(state, node, bar, args):
    w = state.setdefault(node, deque(maxlen=node.period))
    w.append(_range(state, node, bar))
    return sum(w) / len(w) if len(w) == node.period else None


def _chop(state, node, bar, args):
    w = state.setdefault(node, deque(maxlen=node.period))
    w.append((_range(state, node, bar), bar["high"], bar["low"]))
    if len(w) < node.period:
        return None
    total, wide = sum(x[0] for x in w), max(x[1] for x in w) - min(x[2] for x in w)
    return math.log10(total / wide) / math.log10(node.period) if wide > 0 and total > 0 else None


def _ema(state, node, bar, args):
    x, e = args[0], state.get(node)
    if x is None:
        return None
    state[node] = e = x if e is None else e + 2.0 / (node.period + 1) * (x - e)
    return e


def _cross(sign):
    def step(state, node, bar, args):
        before = state.get(node)
        state[node] = args
        if before is None or None in before or None in args:
            return False
        return sign * before[0] <= sign * before[1] and sign * args[0] > sign * args[1]

    return step


def _both(fn):
    return lambda state, node, bar, a: None if None in a else fn(*a)


STEPS = {
    **{c: (lambda state, node, bar, args: bar[node.op]) for c in BAR},
    "constant": lambda state, node, bar, args: node.value,
    "abs": _both(abs),
    "neg": _both(lambda x: -x),
    "add": _both(lambda x, y: x + y),
    "sub": _both(lambda x, y: x - y),
    "gt": lambda state, node, bar, a: None not in a and a[0] > a[1],
    "lt": lambda state, node, bar, a: None not in a and a[0] < a[1],
    "and": lambda state, node, bar, a: all(a),
    "or": lambda state, node, bar, a: any(a),
    "not": lambda state, node, bar, a: not a[0],
    "cross_above": _cross(1),
    "cross_below": _cross(-1),
    "sma": _window(lambda w: sum(w) / len(w)),
    "highest": _window(max),
    "lowest": _window(min),
    "stdev": _window(_stdev),
    "zscore": _window(_zscore),
    "rank": _window(lambda w: sum(x <= w[-1] for x in w) / len(w)),
    "delta": _longer(_delta),
    "ret": _longer(_ret),
    "efficiency_ratio": _longer(_efficiency),
    "rsi": _longer(_rsi),
    "atr": _atr,
    "chop": _chop,
    "ema": _ema,
}


class Evaluator:
    """All expressions of a set for one series; equal subtrees share a state."""

    def __init__(self, named: dict[str, Node]) -> None:
        self.named = named
        self.order = list(dict.fromkeys(x for node in named.values() for x in node.walk()))
        self.state: dict = {}

    def update(self, bar: dict) -> dict:
        """`bar` has open, high, low, close, volume."""
        out: dict[Node, object] = {}
        for x in self.order:
            out[x] = STEPS[x.op](self.state, x, bar, [out[c] for c in x.children])
        return {name: out[node] for name, node in self.named.items()}


def _types(named: dict[str, Node]) -> list[tuple[str, pa.DataType]]:
    return [(k, pa.bool_() if unit_of(v) is Unit.BOOL else pa.float64()) for k, v in named.items()]


def evaluate_sorted(bars: DataFrame, named: dict[str, Node]) -> DataFrame:
    """symbol, bar_idx and the values, by one pass over each sorted series."""
    kinds = _types(named)
    schema = "symbol string, bar_idx long, " + ", ".join(f"`{k}` {'boolean' if t == pa.bool_() else 'double'}" for k, t in kinds)

    def run(batches: Iterator[pa.RecordBatch]):
        now, evaluator = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                if evaluator is None or row["symbol"] != now:
                    now, evaluator = row["symbol"], Evaluator(named)
                out.append(evaluator.update(row))
            columns = [pa.array([r[k] for r in out], t) for k, t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["symbol", "bar_idx", *named])

    parts = int(ship(bars.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    return bars.select("symbol", "bar_idx", *BAR).repartition(parts, "symbol").sortWithinPartitions("symbol", "bar_idx").mapInArrow(run, schema)


def evaluate_stream(bars: DataFrame, named: dict[str, Node]) -> DataFrame:
    """The same on a stream of bars that come in order: one pickled state for each series."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = _types(named)
    out = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("bar_idx", T.LongType())] + [T.StructField(k, T.BooleanType() if t == pa.bool_() else T.DoubleType()) for k, t in kinds])

    class Series(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("last", T.LongType())]))

        def handleInputRows(self, key, rows, timer_values):
            import pandas as pd

            evaluator, last = Evaluator(named), -1
            if self.state.exists():
                held = self.state.get()
                evaluator.state, last = pickle.loads(held[0]), held[1]
            for frame in rows:
                got = []
                for row in frame.sort_values("bar_idx").to_dict("records"):
                    if row["bar_idx"] <= last:
                        raise ValueError(f"bar {row['bar_idx']} of {key[0]} came after bar {last}")
                    last = row["bar_idx"]
                    got.append({"symbol": key[0], "bar_idx": last, **evaluator.update(row)})
                yield pd.DataFrame(got, columns=[f.name for f in out])
            self.state.update((pickle.dumps(evaluator.state), last))

        def close(self) -> None:
            pass

    ship(bars.sparkSession)
    return bars.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Series(), outputStructType=out, outputMode="append", timeMode="None")
