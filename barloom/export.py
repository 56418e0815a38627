"""Rules as source text: one function for each distinct subtree, for terminals with a C-like language."""

from __future__ import annotations

from barloom.functions.expr import Node, Unit
from barloom.plans.compiler import canonical, unit_of

_POINT = {"close": "iClose", "open": "iOpen", "high": "iHigh", "low": "iLow"}
_BINARY = {"add": "+", "sub": "-"}


def _name(node: Node) -> str:
    return f"f_{node.digest[:12]}"


def _body(node: Node) -> str:
    k = [f"{_name(c)}(shift)" for c in node.children]
    p = node.period
    back = lambda c, s: f"{_name(c)}({s})"
    if node.op in _POINT:
        return f"return {_POINT[node.op]}(_Symbol, _Period, shift);"
    if node.op == "volume":
        return "return (double)iVolume(_Symbol, _Period, shift);"
    if node.op == "constant":
        return f"return {node.value!r};"
    if node.op == "abs":
        return f"return MathAbs({k[0]});"
    if node.op == "neg":
        return f"return -{k[0]};"
    if node.op in _BINARY:
        return f"return {k[0]} {_BINARY[node.op]} {k[1]};"
    if node.op in ("gt", "lt"):
        return f"double a = {k[0]}, b = {k[1]}; return MathIsValidNumber(a) && MathIsValidNumber(b) && a {'>' if node.op == 'gt' else '<'} b;"
    if node.op in ("and", "or"):
        return "return " + (" && " if node.op == "and" else " || ").join(k) + ";"
    if node.op == "not":
        return f"return !{k[0]};"
    if node.op in ("cross_above", "cross_below"):
        a, b = node.children if node.op == "cross_above" else node.children[::-1]
        return f"double a1 = {back(a, 'shift + 1')}, b1 = {back(b, 'shift + 1')}, a = {back(a, 'shift')}, b = {back(b, 'shift')}; return MathIsValidNumber(a1 + b1 + a + b) && a1 <= b1 && a > b;"
    if node.op == "delta":
        return f"return {k[0]} - {back(node.children[0], f'shift + {p}')};"
    if node.op == "ret":
        return f"double x = {back(node.children[0], f'shift + {p}')}; return x == 0 ? NaN : {k[0]} / x - 1;"
    child = _name(node.children[0]) if node.children else ""
    if node.op == "ema":
        return f"double e = {child}(shift + {10 * p}); for(int i = {10 * p} - 1; i >= 0; i--) e += 2.0 / ({p} + 1) * ({child}(shift + i) - e); return e;"
    fill = f"double w[]; ArrayResize(w, {{n}}); for(int i = 0; i < {{n}}; i++) w[i] = {child}(shift + {{n}} - 1 - i);"
    if node.op in ("atr", "chop"):
        return f"return {node.op}_window(shift, {p});"
    width = p + 1 if node.op in ("efficiency_ratio", "rsi") else p
    return fill.format(n=width) + f" return {node.op}_window(w);"


def functions(nodes: list[Node]) -> str:
    """Definitions of all distinct subtrees, inputs before what uses them."""
    seen: dict[str, str] = {}
    for node in map(canonical, nodes):
        for x in node.walk():
            kind = "bool" if unit_of(x) is Unit.BOOL else "double"
            seen.setdefault(_name(x), f"{kind} {_name(x)}(int shift) {{ {_body(x)} }}  // {x.op}{'' if x.period is None else f'({x.period})'}")
    return "\n".join(seen.values()) + "\n"
