"""Event-level and case-level selection. The two are separate functions on purpose:
an event filter truncates cases, a case filter keeps all events of the selected cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.timing import moment
from loomtrail.model import EventFilter


def in_range(log: DataFrame, date_from: datetime | None = None, date_to: datetime | None = None) -> DataFrame:
    """Half-open range ``[date_from, date_to)`` on the event time."""
    if date_from is not None:
        log = log.filter(F.col("event_ts") >= moment(date_from))
    if date_to is not None:
        log = log.filter(F.col("event_ts") < moment(date_to))
    return log


def filter_events(log: DataFrame, spec: EventFilter) -> DataFrame:
    """Apply every part of the specification to single events."""
    log = in_range(log, spec.date_from, spec.date_to)
    for column, allowed in (
        ("process_domain", spec.process_domains),
        ("org_code", spec.org_codes),
        ("activity", spec.include_activities),
        ("result_code", spec.result_codes),
        *spec.attributes.items(),
    ):
        if allowed:
            log = log.filter(F.col(column).isin(*allowed))
    if spec.exclude_activities:
        log = log.filter(~F.col("activity").isin(*spec.exclude_activities))
    if spec.mapping_version is not None:
        log = log.filter(F.col("mapping_version") == spec.mapping_version)
    return log


def matching_cases(log: DataFrame, spec: EventFilter) -> DataFrame:
    return filter_events(log, spec).select("case_id").distinct()


def filter_cases(log: DataFrame, spec: EventFilter) -> DataFrame:
    """All events of every case that has at least one matching event."""
    return log.join(matching_cases(log, spec), "case_id", "left_semi")


def keep_cases(log: DataFrame, cases: DataFrame) -> DataFrame:
    return log.join(cases.select("case_id"), "case_id", "left_semi")


def filter_signature(
    spec: EventFilter,
    dataset: str | None = None,
    level: str = "source",
    mapping_set: int | None = None,
    unmapped: str | None = None,
    limits: dict[str, int] | None = None,
) -> str:
    """Stable text that identifies what a result was computed from: the data set, the level of activities with
    its mapping set and treatment of unmapped ones, the filter, and the display limits."""
    parts = [f"dataset={dataset}" if dataset else "all-events"]
    if level != "source":
        parts.append(f"activity-level={level}")
    if mapping_set is not None:
        parts.append(f"mapping-set=v{mapping_set}")
    if unmapped is not None:
        parts.append(f"unmapped={unmapped}")
    if spec.date_from:
        parts.append(f"from={spec.date_from.isoformat()}")
    if spec.date_to:
        parts.append(f"to={spec.date_to.isoformat()}")
    for name in ("process_domains", "org_codes", "include_activities", "exclude_activities", "result_codes"):
        values = getattr(spec, name)
        if values:
            parts.append(f"{name}={','.join(sorted(values))}")
    if spec.mapping_version:
        parts.append(f"mapping={spec.mapping_version}")
    parts.extend(f"{k}={','.join(sorted(v))}" for k, v in sorted(spec.attributes.items()))
    parts.extend(f"{k}={v}" for k, v in sorted((limits or {}).items()))
    return ";".join(parts)
