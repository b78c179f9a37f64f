"""Options of a run: defaults, bounds, and combinations that are refused."""

from __future__ import annotations

import dataclasses
from datetime import UTC, datetime

MODES = ("auto", "complete", "targeted")


@dataclasses.dataclass(frozen=True)
class Options:
    mode: str = "complete"
    task: str | None = None
    no_ai: bool = False
    max_pages: int | None = None
    min_relevance: float = 0.0
    mirror_hamming: int = 8
    near_dup_hamming: int = 0
    max_routes: int = 200
    max_actions: int = 40
    concurrency: int = 4
    include: str | None = None
    exclude: str | None = None
    incremental: bool = False
    per_document: bool = False
    embed_model: str | None = None

    @classmethod
    def of(cls, **given) -> Options:
        """Checked and bounded; a mode that is missing or empty is ``auto``."""
        if not given.get("mode", "complete"):
            given["mode"] = "auto"
        o = cls(**given)
        if o.mode not in MODES:
            raise ValueError(f"unknown mode {o.mode!r}; one of {', '.join(MODES)}")
        if o.no_ai and o.mode == "targeted":
            raise ValueError("targeted needs a model")
        if o.no_ai and (o.task or "").strip():
            raise ValueError("without a model a task has no effect")
        if o.no_ai and o.min_relevance > 0:
            raise ValueError("without a model there is no relevance")
        bits = lambda n: max(0, min(64, int(n)))
        return dataclasses.replace(
            o, mirror_hamming=bits(o.mirror_hamming), near_dup_hamming=bits(o.near_dup_hamming), concurrency=max(1, o.concurrency),
            max_pages=None if o.max_pages is None or o.max_pages <= 0 else int(o.max_pages), min_relevance=max(0.0, min(1.0, o.min_relevance)),
        )


def new_run_id(at: datetime | None = None) -> str:
    return (at or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S-%f")[:-3]


def trim_url(raw: str | None) -> str:
    return (raw or "").strip().rstrip("/")


def api_base(raw: str | None) -> str:
    """A provider's base address with its version path once."""
    u = trim_url(raw)
    return u if not u or u.endswith("/v1") else f"{u}/v1"
