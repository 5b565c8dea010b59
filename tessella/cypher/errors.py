"""Errors with the codes that openCypher names."""

from __future__ import annotations


class CypherError(ValueError):
    """phase: syntax, runtime or execution."""

    def __init__(self, code: str, detail: str = "", phase: str = "syntax"):
        super().__init__(f"{phase} error: {code}" + (f" ({detail})" if detail else ""))
        self.code, self.phase = code, phase


class ResourceLimitExceeded(CypherError):
    def __init__(self, kind: str, limit: int, observed: int, stage: str):
        super().__init__("ResourceLimitExceeded", f"{kind}: {observed} over {limit} in {stage}", "execution")
        self.kind, self.limit, self.observed, self.stage = kind, limit, observed, stage
