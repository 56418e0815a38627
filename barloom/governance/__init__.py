"""Seals and records around an experiment: manifests, the lockbox, states, message contracts."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.errors import ContractError, LockboxError, StateError
from barloom.operators import hashtree
from barloom.operators.splits import Plan


def canonical_json(doc) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)


def digest_of(doc) -> str:
    return hashlib.sha256(canonical_json(doc).encode()).hexdigest()


_BAR = ("symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume")


def content_tree(bars: DataFrame) -> DataFrame:
    """The hash tree of all bars: symbol, level, node, digest, n_rows."""
    return hashtree.tree(bars.select(*(c for c in _BAR if c in bars.columns)), ["symbol"], "bar_idx")


def content_digest(bars: DataFrame) -> str:
    """The root of the hash tree of all bars; it does not depend on partitioning."""
    return hashtree.root(content_tree(bars), ["symbol"])


def write_once(path: str, doc: dict) -> None:
    """Equal content is a no-op, other content raises; the file appears whole or not at all."""
    target = Path(path)
    text = json.dumps(doc, sort_keys=True, indent=1)
    if target.exists():
        if digest_of(json.loads(target.read_text())) != digest_of(doc):
            raise StateError("manifest exists with other content", path=path)
        return
    fd, tmp = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(tmp, target)


def manifest(bars: DataFrame) -> dict:
    return {"schema": "1", "n_bars": bars.count(), "content": content_digest(bars)}


def verify_manifest(path: str, bars: DataFrame) -> None:
    if json.loads(Path(path).read_text()) != manifest(bars):
        raise StateError("data differs from its manifest", path=path)


#: States and what may follow each, and the seals that one needs to leave the first.
TRANSITIONS = {
    "CREATED": {"SEALED"},
    "SEALED": {"SEARCH_ACTIVE"},
    "SEARCH_ACTIVE": {"SHORTLISTED", "CLOSED_NO_EDGE"},
    "SHORTLISTED": {"FROZEN", "CLOSED_NO_EDGE"},
    "FROZEN": {"DISCLOSED"},
    "DISCLOSED": {"CLOSED_ACCEPTED", "CLOSED_REJECTED"},
}
REQUIRED_SEALS = ("data_content_hash", "split_plan_hash", "config_hash", "seed")
LOCKBOX_ACTOR = "lockbox_guard"


class Experiment:
    """A state machine with an append-only log and seals that may be set once."""

    def __init__(self, name: str) -> None:
        self.name, self.state, self.seals, self.log = name, "CREATED", {}, []

    def seal(self, key: str, value: str) -> None:
        if self.seals.setdefault(key, value) != value:
            raise StateError("seal exists with another value", key=key)

    def move(self, to: str, actor: str = "engine", reason: str = "") -> None:
        if to not in TRANSITIONS.get(self.state, ()):
            raise StateError("no such transition", of=self.state, to=to)
        if self.state == "CREATED" and (missing := [k for k in REQUIRED_SEALS if k not in self.seals]):
            raise StateError("seals are missing", missing=missing)
        if to == "DISCLOSED" and actor != LOCKBOX_ACTOR:
            raise StateError("only the lockbox discloses", actor=actor)
        self.log.append({"of": self.state, "to": to, "actor": actor, "reason": reason})
        self.state = to

    def save(self, path: str) -> None:
        Path(path).write_text(canonical_json({"name": self.name, "state": self.state, "seals": self.seals, "log": self.log}))

    @staticmethod
    def load(path: str) -> "Experiment":
        doc = json.loads(Path(path).read_text())
        out = Experiment(doc["name"])
        out.state, out.seals, out.log = doc["state"], doc["seals"], doc["log"]
        if (out.log[-1]["to"] if out.log else "CREATED") != out.state:
            raise StateError("state does not follow from the log", path=path)
        return out


class Lockbox:
    """The held-out tail can be read once, from a frozen experiment whose seals still hold."""

    def __init__(self, experiment: Experiment, plan: Plan) -> None:
        self.experiment, self.plan = experiment, plan

    def research(self, bars: DataFrame) -> DataFrame:
        return bars.where(F.col("bar_idx") < self.plan.lockbox[0])

    def open(self, bars: DataFrame, actor: str, reason: str) -> DataFrame:
        e = self.experiment
        if e.state != "FROZEN" or not actor or not reason:
            raise LockboxError("only a frozen experiment opens its lockbox, once, for a stated reason", state=e.state)
        if e.seals.get("split_plan_hash") != digest_of(self.plan.rows()) or e.seals.get("data_content_hash") != content_digest(bars):
            raise LockboxError("plan or data differ from their seals")
        e.move("DISCLOSED", LOCKBOX_ACTOR, f"{actor}: {reason}")
        return bars.where(F.col("bar_idx") >= self.plan.lockbox[0])


#: What no key in a message to a model may contain, and what proposals of features need.
FORBIDDEN_IN_KEYS = ("lockbox", "holdout", "sealed_test", "final_test")
_NAME = re.compile(r"^[a-z][a-z0-9_]{2,40}$")


def forbid_lockbox(doc, path: str = "$") -> None:
    if isinstance(doc, dict):
        for k, v in doc.items():
            if any(term in str(k).lower() for term in FORBIDDEN_IN_KEYS):
                raise ContractError("held-out content in a message", at=f"{path}.{k}")
            forbid_lockbox(v, f"{path}.{k}")
    elif isinstance(doc, (list, tuple)):
        for k, v in enumerate(doc):
            forbid_lockbox(v, f"{path}[{k}]")


def check_proposal(doc: dict) -> dict:
    """A proposed feature is described and checked, never run."""
    inputs = set(doc.get("inputs", ()))
    problems = [
        ("name", not isinstance(doc.get("name"), str) or not _NAME.match(doc["name"])),
        ("causal", doc.get("causal") is not True),
        ("inputs", not inputs or not inputs <= {"open", "high", "low", "close", "volume", "atr"}),
        ("output", doc.get("output") not in ("return", "zscore", "osc_0_1", "osc_0_100", "price", "volatility", "volume")),
        ("lookback", not doc.get("lookback_parameters")),
        ("complexity", not isinstance(doc.get("complexity"), int) or doc["complexity"] < 1),
        ("hypothesis", not doc.get("hypothesis")),
        ("failure_mode", not doc.get("failure_mode")),
        ("code", any(t in canonical_json(doc) for t in ("import ", "exec(", "eval(", "__"))),
    ]
    bad = [k for k, wrong in problems if wrong]
    if bad:
        raise ContractError("proposal rejected", fields=bad)
    return doc


def reproduction() -> dict:
    """What ran: interpreter, platform and the commit, if there is one."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=Path(__file__).parent, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    import pyspark

    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "commit": commit}
