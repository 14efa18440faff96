"""Data model: the canonical event log and the versioned settings that shape it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum

from pyspark.sql import types as T

# Column names and order of the canonical event log.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("process_domain", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_class", T.StringType()),
        T.StructField("source_method", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("org_code", T.StringType()),
        T.StructField("actor_hash", T.StringType()),
        T.StructField("result_code", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("source_sequence", T.LongType()),
        T.StructField("ingest_sequence", T.LongType()),
        T.StructField("mapping_version", T.StringType()),
        T.StructField("case_rule_version", T.StringType()),
        T.StructField("ingestion_batch_id", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("source_timezone", T.StringType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
)

# Total order of the events of one case.
ORDER_KEYS = ("event_ts", "source_sequence", "source_event_id", "ingest_sequence")

# Logical names a binding may add to the three required ones.
OPTIONAL_ATTRIBUTES = (
    "resource",
    "user",
    "department",
    "system",
    "method",
    "status",
    "duration",
    "source_sequence",
)
NUMERIC_ATTRIBUTES = ("duration", "source_sequence")

# Ordering fields a contract may name.
CONTRACT_ORDERING = ("event_ts", "source_sequence", "event_id", "source_row_number")

# Label given to events whose activity has no mapping entry.
UNMAPPED_LABEL = "__UNMAPPED__"

# Display limits.
MAX_NODES = 100
MAX_EDGES = 300
MAX_VARIANTS = 100
MAX_PREVIEW_ROWS = 200
CASE_PAGE_SIZE = 100
LARGE_CASE_EVENTS = 10_000


class Retention(StrEnum):
    KEEP = "KEEP"
    DROP = "DROP"
    PSEUDONYMIZE = "PSEUDONYMIZE"


class PiiClass(StrEnum):
    NONE = "NONE"
    PII = "PII"
    SENSITIVE = "SENSITIVE"


class UnmappedPolicy(StrEnum):
    KEEP_SOURCE = "KEEP_SOURCE"
    GROUP_AS_UNMAPPED = "GROUP_AS_UNMAPPED"
    EXCLUDE = "EXCLUDE"


@dataclass(frozen=True)
class ColumnBinding:
    """Which source column plays which logical role."""

    case_id: str
    activity: str
    timestamp: str
    event_id: str | None = None
    optional: Mapping[str, str] = field(default_factory=dict)
    timestamp_format: str | None = None
    version: int = 1

    def check(self, columns: list[str]) -> None:
        """Reject an unusable binding before any plan is built."""
        if len({self.case_id, self.activity, self.timestamp}) < 3:
            raise ValueError("case, activity and timestamp must use three different columns")
        unknown = sorted(set(self.optional) - set(OPTIONAL_ATTRIBUTES))
        if unknown:
            raise ValueError(f"not a bindable attribute: {unknown}")
        bound = [self.case_id, self.activity, self.timestamp, *self.optional.values()]
        if self.event_id is not None:
            bound.append(self.event_id)
        missing = sorted({c for c in bound if c not in columns})
        if missing:
            raise ValueError(f"columns missing from the source: {missing}")


@dataclass(frozen=True)
class SemanticContract:
    """Policy for time zone, personal data, retention and ordering."""

    source_timezone: str = "UTC"
    display_timezone: str | None = None
    pseudonymize_case_id: bool = False
    retention: Mapping[str, Retention] = field(default_factory=dict)
    pii: Mapping[str, PiiClass] = field(default_factory=dict)
    ordering: tuple[str, ...] = CONTRACT_ORDERING
    version: int = 1

    def check(self) -> None:
        targets = {*OPTIONAL_ATTRIBUTES, "event_id"}
        stray = sorted((set(self.retention) | set(self.pii)) - targets)
        if stray:
            raise ValueError(f"policy set for an unknown attribute: {stray}")
        numeric = [n for n in NUMERIC_ATTRIBUTES if self.retention.get(n) == Retention.PSEUDONYMIZE]
        if numeric:
            raise ValueError(f"numeric attributes cannot be pseudonymized: {numeric}")
        legal = sorted(self.ordering) == sorted(CONTRACT_ORDERING)
        if not legal or self.ordering[0] != "event_ts" or self.ordering[-1] != "source_row_number":
            raise ValueError(f"ordering must be a legal permutation of {CONTRACT_ORDERING}")

    def resolve(self, binding: ColumnBinding) -> dict[str, Retention]:
        """Policy per attribute: stated, else DROP for personal data, else KEEP; unbound = DROP."""
        self.check()
        bound = set(binding.optional) | ({"event_id"} if binding.event_id else set())
        resolved = {}
        for name in (*OPTIONAL_ATTRIBUTES, "event_id"):
            if name not in bound:
                resolved[name] = Retention.DROP
            elif name in self.retention:
                resolved[name] = self.retention[name]
            else:
                plain = self.pii.get(name, PiiClass.NONE) == PiiClass.NONE
                resolved[name] = Retention.KEEP if plain else Retention.DROP
        return resolved


@dataclass(frozen=True)
class EventFilter:
    """Half-open event-time range plus optional value lists; empty means no restriction."""

    date_from: datetime | None = None
    date_to: datetime | None = None
    process_domains: tuple[str, ...] = ()
    org_codes: tuple[str, ...] = ()
    include_activities: tuple[str, ...] = ()
    exclude_activities: tuple[str, ...] = ()
    result_codes: tuple[str, ...] = ()
    mapping_version: str | None = None
    attributes: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from >= self.date_to:
            raise ValueError("date_from must be before date_to")


def effective_limit(requested: int | None, cap: int) -> int:
    """A request may lower a display cap but never raise it."""
    if requested is not None and requested < 1:
        raise ValueError("a limit must be positive")
    return cap if requested is None else min(requested, cap)
