"""The records that planning passes around. Bounds: date, int, {modulus, remainder} or a list value; MAX is no upper bound."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import date

MAX = "max"


def shown(bound: object) -> object:
    """A bound as reports and signatures print it."""
    return bound.isoformat() if isinstance(bound, date) else bound


@dataclass(frozen=True)
class Segment:
    name: str
    start: object
    end: object
    kind: str  # filler, future, hot_bucket, archive, branch

    def signature(self) -> list:
        return [self.name, shown(self.start), shown(self.end), self.kind]

    def bounds(self) -> tuple:
        return self.name, json.dumps(shown(self.start), default=str), json.dumps(shown(self.end), default=str)


@dataclass(frozen=True)
class Plan:
    segments: tuple[Segment, ...]
    hot: tuple = ()

    def signature(self) -> str:
        return signature(self.segments)

    def changed(self, attached: list[Segment]) -> bool:
        return sorted(s.bounds() for s in self.segments) != sorted(s.bounds() for s in attached)


def signature(segments) -> str:
    """Sixteen hex digits of the SHA-256 of the sorted segment signatures."""
    rows = sorted((s.signature() for s in segments), key=lambda r: json.dumps(r, separators=(",", ":")))
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Operation:
    action: str  # create, keep, reshape, drop
    segment: Segment | None
    attached: Segment | None


@dataclass(frozen=True)
class Gap:
    start: object
    end: object
    message: str


@dataclass
class AuditResult:
    table_name: str
    partitioned: bool
    default_row_count: int = 0
    attached_child_count: int = 0
    horizon_days: int | None = None
    gaps: list[Gap] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class PlanReport:
    schema_version: str
    table_name: str
    layout: str
    today: str
    active_window: list
    hot_buckets: list
    segments: list[dict]
    operations: list[dict]
    gaps: list[dict]
    plan_signature: str
    changed: bool

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(asdict(self), indent=2 if pretty else None, default=str)


@dataclass
class RunMetrics:
    table_name: str
    duration_ms: int = 0
    plan_signature: str | None = None
    rows_moved: int = 0
    skipped: bool = False
    skip_reason: str | None = None


@dataclass
class RunSummary:
    tables: list[RunMetrics] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    schema_version: str = "1.0"
