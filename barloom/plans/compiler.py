"""Expressions to plans: checks, canonical form, and one DataFrame for many expressions.

Every distinct subtree becomes one column, named by its digest, so common
parts of many expressions are computed once.  Columns are added level by
level; all windows of a stage have one partitioning (series and chunk, with a
halo) and order, so a stage has one exchange and one sort.  Only a recursive
average under a window makes another stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.errors import CompileError
from barloom.functions.expr import Node, Unit
from barloom.functions.ops import get
from barloom.plans.chunks import add_averages, longest_chunk, with_halo, without_halo


def unit_of(node: Node) -> Unit:
    """Checks structure and units from the leaves up."""
    op = get(node.op)
    k = len(node.children)
    if op.arity is None and k < 2 or op.arity is not None and k != op.arity:
        raise CompileError(f"{node.op} takes {'two or more' if op.arity is None else op.arity} inputs", got=k)
    if op.least_period is None and node.period is not None:
        raise CompileError(f"{node.op} takes no period", period=node.period)
    if op.least_period is not None and (node.period is None or node.period < op.least_period):
        raise CompileError(f"{node.op} needs a period of {op.least_period} or more", period=node.period)
    if node.op != "constant" and (node.value is not None or node.unit is not None):
        raise CompileError(f"{node.op} takes no value or unit")
    return op.units(node, [unit_of(c) for c in node.children])


def lookback(node: Node) -> int:
    """Bars before the first full value; a recursive average reports none of its own."""
    return get(node.op).lookback(node.period or 0) + max((lookback(c) for c in node.children), default=0)


def complexity(node: Node) -> int:
    return get(node.op).cost + sum(map(complexity, node.children))


def _once(node: Node) -> Node:
    kids = tuple(map(_once, node.children))
    node = Node(node.op, kids, node.period, node.value, node.unit)
    first = kids[0] if len(kids) == 1 else None
    if node.op in ("neg", "not") and first.op == node.op:
        return first.children[0]
    if node.op == "abs" and first.op in ("abs", "neg"):
        return Node("abs", first.children)
    if node.op in ("lt", "cross_below"):
        return Node("gt" if node.op == "lt" else "cross_above", kids[::-1])
    if node.op in ("and", "or"):
        flat: dict[str, Node] = {}
        for c in kids:
            for x in c.children if c.op == node.op else (c,):
                flat.setdefault(x.text, x)
        ordered = tuple(flat[k] for k in sorted(flat))
        return ordered[0] if len(ordered) == 1 else Node(node.op, ordered)
    if node.op == "add":
        return Node("add", tuple(sorted(kids, key=lambda c: c.text)))
    return node


def canonical(node: Node) -> Node:
    """Rewrites until nothing changes: equal meanings get one form and one digest."""
    while (new := _once(node)) != node:
        node = new
    return node


def column_name(node: Node) -> str:
    return f"f_{node.digest[:16]}"


def _depth(node: Node, seen: dict[Node, int]) -> int:
    if node not in seen:
        seen[node] = 1 + max((_depth(c, seen) for c in node.children), default=-1)
    return seen[node]


def _stages(named: dict[str, Node]) -> dict[Node, int]:
    """The stage of every subtree: a recursive average ends a stage, so what uses one comes in the next."""
    found: dict[Node, int] = {}

    def of(node: Node) -> int:
        if node not in found:
            found[node] = max((of(c) + (c.op == "ema") for c in node.children), default=0)
        return found[node]

    for node in named.values():
        of(node)
    return found


def _reach(node: Node, stage: dict[Node, int]) -> int:
    """Bars before one that its value in the node's stage may need."""
    own = 0 if node.op == "ema" else get(node.op).lookback(node.period or 0)
    return own + max((_reach(c, stage) for c in node.children if stage[c] == stage[node] and c.op != "ema"), default=0)


def evaluate(bars: DataFrame, named: dict[str, Node], keep: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """`bars` (or its columns `keep`) with a column for each named expression; `bar_idx` counts the bars of a series without gaps.

    Windows see chunks of `chunk` bars with a halo as long as the lookback of
    the stage; results do not depend on `chunk`.
    """
    nodes: dict[Node, int] = {}
    for node in named.values():
        unit_of(node)
        _depth(node, nodes)
    stage = _stages(named)
    df = bars
    for now in range(1 + max(stage.values(), default=0)):
        mine = [x for x, s in stage.items() if s == now]
        averages = [(column_name(x.children[0]), column_name(x), x.period) for x in mine if x.op == "ema"]
        halo = max((_reach(x, stage) for x in mine), default=0)
        halo += halo > 0  # the bar before the first range
        longest = longest_chunk([p for _, _, p in averages])
        size = min(chunk or max(longest, 0 if averages else 8 * halo), longest if averages else 1 << 62)
        if halo or averages:
            df = with_halo(df, size, halo)
        for depth in range(1 + max(nodes.values(), default=0)):
            ready = {column_name(x): get(x.op).build(x, [F.col(column_name(c)) for c in x.children]) for x in mine if nodes[x] == depth and x.op != "ema"}
            df = df.withColumns(ready) if ready else df
        df = without_halo(df, size) if halo else df
        df = add_averages(df, averages) if averages else df
    return df.select(*(keep or bars.columns), *(F.col(column_name(x)).alias(name) for name, x in named.items()))


def ema_array(values: np.ndarray, period: int) -> np.ndarray:
    """The recursion for one array, for tests and small series."""
    out, e = np.full(len(values), np.nan), None
    for i, x in enumerate(values):
        if np.isfinite(x):
            e = x if e is None else e + 2.0 / (period + 1) * (x - e)
            out[i] = e
    return out
