"""Error types; each carries the facts that explain it."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, **facts) -> None:
        super().__init__(message + (f" ({', '.join(f'{k}={v!r}' for k, v in facts.items())})" if facts else ""))
        self.facts = facts


class ParseError(EngineError): ...
class UnitError(EngineError): ...
class CompileError(EngineError): ...
class SourceError(EngineError): ...
class QualityError(EngineError): ...
class MetadataError(EngineError): ...
class SplitError(EngineError): ...
class PolicyError(EngineError): ...
class StatisticsError(EngineError): ...
class RouterError(EngineError): ...
class MemoryError_(EngineError): ...
class LockboxError(EngineError): ...
class StateError(EngineError): ...
class ContractError(EngineError): ...
