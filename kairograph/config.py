"""Defaults that are part of a query's meaning."""

from __future__ import annotations

import secrets
import tomllib
import zoneinfo
from collections.abc import Mapping
from dataclasses import dataclass, field

# Defaults of the graph engine's operators.
KINDS = ("person", "memory", "plan", "place", "task")
EDGE_TYPES = (
    "LIVES_AT", "ATTENDS", "ATTENDED", "WORKS_AT", "WORKED_AT", "FREQUENTS", "FROM", "ROOMMATE_OF", "FRIEND_OF", "PARTNER_OF", "SIBLING_OF", "PARENT_OF",
    "FAMILY_OF", "COWORKER_OF", "CLASSMATE_OF", "KNOWS", "ABOUT", "PREFERS", "DISLIKES", "PARTICIPANT", "ENROLLED_IN", "TEACHES", "MEMBER_OF", "WORKS_ON",
    "OWNS", "HAS_FACET", "HAS_ITEM", "HAS_PLAN", "HAS_NOTE", "FOR", "AT_LOCATION", "RELATED_TO",
)
SYMMETRIC_TYPES = ("ROOMMATE_OF", "FRIEND_OF", "SIBLING_OF", "PARTNER_OF", "COWORKER_OF", "CLASSMATE_OF")
HISTORY_FIELDS = ("title", "body", "occurred_at", "deleted", "done", "agent_id")
OPERATIONS = ("create_node", "update_node", "close_node", "create_edge", "close_edge", "spawn_plans", "update_plans", "noop", "edge_exists")
GENERIC_QUERY_WORDS = ("about", "class", "does", "from", "have", "know", "meeting", "session", "tell", "that", "this", "what", "when", "where", "which", "with", "your")
GENERIC_TITLE_WORDS = ("class", "session", "with", "meeting")
HUB_DEGREE = 100
OPEN_TASK_PAST_DAYS, OPEN_TASK_AHEAD_DAYS = 14, 60
TITLE_ANCHOR_LIMIT, CLOSEST_HUB_LIMIT = 4, 5
MIN_SEGMENT_CHARS, MIN_EVIDENCE_CHARS = 12, 8
LOOKALIKE_HOURS, ALL_DAY_HOURS, LONG_SPAN_DAYS, HISTORY_PAGE = 12, 23, 7, 50


@dataclass(frozen=True)
class EngineConfig:
    dimension: int = 1536
    embed_batch: int = 64
    page_default: int = 50
    page_max: int = 200
    search_default: int = 10
    search_max: int = 100
    similarity_floor: float = 0.35
    candidate_limit: int = 20
    segment_limit: int = 12
    segment_candidate_limit: int = 5
    edge_context_limit: int = 50
    anchor_floor: float = 0.4
    anchor_limit: int = 8
    hop_cap: int = 3
    relevance_threshold: float = 0.15
    marginal_yield_minimum: int = 1
    token_budget: int = 4000
    coverage_top_n: int = 5
    coverage_floor: float = 0.25
    recall_default: int = 20
    recency_half_life_days: float = 30.0
    weights: dict = field(default_factory=lambda: {"semantic": 0.4, "proximity": 0.2, "recency": 0.15, "frequency": 0.1, "edge_confidence": 0.15})
    kind_priors: dict = field(default_factory=lambda: {k: 1.0 for k in KINDS})

    def __post_init__(self):
        if self.page_default > self.page_max or self.search_default > self.search_max or self.recall_default > self.page_max:
            raise ValueError("a default may not exceed its maximum")


class EngineError(Exception):
    """A typed failure: status and type of the answer."""

    status, kind = 500, "internal_error"

    def body(self) -> dict:
        """The answer that a service gives."""
        return {"error": {"type": self.kind, "message": str(self)}}


class InvalidRequest(EngineError):
    status, kind = 422, "invalid_request"


class NotFound(EngineError):
    status, kind = 404, "not_found"


class Conflict(EngineError):
    status, kind = 409, "conflict"


class UnlinkedNode(EngineError):
    status, kind = 422, "unlinked_node"


class UpstreamError(EngineError):
    """A given embedder or extractor failed; answered is the status it gave, None if it gave none."""

    status, kind = 502, "upstream"

    def __init__(self, message: str, answered: int | None = None):
        super().__init__(message)
        self.answered = answered


#: The file's sections and keys by the field that each sets.
FILE_KEYS = {
    "embedding.dimension": "dimension", "embedding.batch_size": "embed_batch", "page.default_size": "page_default", "page.max_size": "page_max", "search.default_limit": "search_default", "search.max_limit": "search_max",
    "ingest.candidate_similarity_floor": "similarity_floor", "ingest.candidate_limit": "candidate_limit", "ingest.segment_limit": "segment_limit",
    "ingest.segment_candidate_limit": "segment_candidate_limit", "ingest.edge_context_limit": "edge_context_limit", "recall.anchor_similarity_floor": "anchor_floor",
    "recall.anchor_limit": "anchor_limit", "recall.hop_cap": "hop_cap", "recall.relevance_threshold": "relevance_threshold",
    "recall.marginal_yield_minimum": "marginal_yield_minimum", "recall.token_budget": "token_budget", "recall.coverage_top_n": "coverage_top_n",
    "recall.coverage_floor": "coverage_floor", "recall.default_limit": "recall_default", "recall.recency_half_life_days": "recency_half_life_days",
    "recall.weights": "weights", "recall.kind_priors": "kind_priors",
}


def load_config(path: str, env: Mapping[str, str]) -> tuple[EngineConfig, str]:
    """The configuration of a TOML file, and the zone that env names as TZ.  Sections of other
    parts are left alone.  Raises for an unknown key, a value that is no number or below zero, or an unknown zone."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    values = {}
    sections = {k.split(".")[0] for k in FILE_KEYS}
    for section, entries in found.items():
        for name, value in entries.items() if section in sections else ():
            key = FILE_KEYS.get(f"{section}.{name}")
            if key is None:
                raise ValueError(f"{path}: unknown key {section}.{name}")
            numbers = value.values() if isinstance(value, dict) else [value]
            if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 for x in numbers):
                raise ValueError(f"{path}: {section}.{name} must be a number, not below zero")
            values[key] = value
    zone = env.get("TZ")
    if not zone or zone not in zoneinfo.available_timezones():
        raise ValueError(f"TZ is no time zone: {zone}")
    return EngineConfig(**values), zone


def request_line(request_id: str | None, method: str, url: str, status: int, seconds: float) -> tuple[str, dict]:
    """The level and the fields of the log line of a request; one without an id gets one."""
    level = "error" if status >= 500 else "warning" if status >= 400 else "info"
    return level, {"request_id": (request_id or "").strip() or secrets.token_hex(8), "method": method, "path": url.split("?")[0], "status": status, "duration_ms": round(seconds * 1000)}
