"""Flags of a run and what they may be together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import EngineError, Kind
from .memo import MemoConfig


@dataclass
class RunFlags:
    assert_: str = "never"
    eval_: str = "topdown"
    cache: str = "readwrite"
    invalidate: str = ""
    recomputeempty: bool = False
    postusechecksum: bool = False
    pred: bool = False
    dotgraph: bool = False
    traceflow: bool = False
    backgroundtimeout: float = 600.0
    nocacheextern: bool = False
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name, value, known in (("assert", self.assert_, ("never", "exact")), ("eval", self.eval_, ("topdown", "bottomup")), ("cache", self.cache, ("off", "read", "write", "readwrite"))):
            if value not in known:
                raise EngineError(Kind.INVALID, f"flag {name} is one of {', '.join(known)}, not {value}")
        if self.invalidate:
            try:
                re.compile(self.invalidate)
            except re.error as e:
                raise EngineError(Kind.INVALID, f"flag invalidate: {e}") from e
        if self.backgroundtimeout < 0:
            raise EngineError(Kind.INVALID, "flag backgroundtimeout is not negative")
        if self.pred and self.cache in ("off", "write"):
            raise EngineError(Kind.INVALID, "flag pred needs a cache that is read")
        if self.nocacheextern:
            self.warnings.append("flag nocacheextern is deprecated: externs are never cached")

    def memo(self) -> MemoConfig:
        return MemoConfig.of_flags(self.assert_, self.eval_, self.cache, self.invalidate or None, self.recomputeempty, self.nocacheextern)


def unused(names: list[str], used: set[str]) -> list[str]:
    """Warnings of declared names that nothing uses; a leading underscore says it is meant."""
    return [f"{n} is declared but not used" for n in names if n not in used and not n.startswith("_")]
