"""The expression language: nodes, units, and their JSON form."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from barloom.errors import ParseError


class Unit(str, Enum):
    PRICE = "price"
    VOLUME = "volume"
    VOLATILITY = "volatility"
    RETURN = "return"
    ZSCORE = "zscore"
    OSC_0_1 = "osc_0_1"
    OSC_0_100 = "osc_0_100"
    TIME = "time"
    UNSCALED = "unscaled"
    BOOL = "bool"


COMPARABLE = frozenset(u for u in Unit if u not in (Unit.BOOL, Unit.UNSCALED))
NUMERIC = frozenset(u for u in Unit if u is not Unit.BOOL)
SIGNED = frozenset({Unit.RETURN, Unit.ZSCORE, Unit.UNSCALED})


@dataclass(frozen=True)
class Node:
    op: str
    children: tuple["Node", ...] = field(default=())
    period: int | None = None
    value: float | None = None
    unit: str | None = None

    def to_dict(self) -> dict:
        out: dict = {"op": self.op}
        for key in ("period", "value", "unit"):
            if getattr(self, key) is not None:
                out[key] = getattr(self, key)
        if self.children:
            out["children"] = [c.to_dict() for c in self.children]
        return out

    @staticmethod
    def of(doc) -> "Node":
        if not isinstance(doc, dict) or not isinstance(doc.get("op"), str):
            raise ParseError("a node is an object with an op", got=str(doc)[:80])
        unknown = set(doc) - {"op", "period", "value", "unit", "children"}
        if unknown:
            raise ParseError("unknown keys", keys=sorted(unknown))
        period = doc.get("period")
        if period is not None and (isinstance(period, bool) or not isinstance(period, int)):
            raise ParseError("period must be a whole number", period=period)
        value = doc.get("value")
        return Node(doc["op"], tuple(map(Node.of, doc.get("children", ()))), period, None if value is None else float(value), doc.get("unit"))

    @property
    def text(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"))

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()

    def walk(self) -> Iterator["Node"]:
        """Children before parents."""
        for c in self.children:
            yield from c.walk()
        yield self


def n(op: str, *children: Node, period: int | None = None) -> Node:
    return Node(op, children, period)


def const(value: float, unit: Unit | str) -> Node:
    return Node("constant", value=float(value), unit=Unit(unit).value)


CLOSE, OPEN, HIGH, LOW, VOLUME = (Node(c) for c in ("close", "open", "high", "low", "volume"))
