"""Case-id extraction rules, provisional duplicate keys and attribute whitelists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.privacy import hmac_token
from loomtrail.functions.text import blank_to_null
from loomtrail.functions.timing import moment


@dataclass(frozen=True)
class CaseRule:
    """``kind``: ``column`` (one column), ``json_path`` (``column`` and ``path``), ``composite``
    (several columns) or ``correlation`` (a request or session id, taken like a column)."""

    rule_id: str
    kind: str
    columns: tuple[str, ...]
    priority: int = 100
    path: str | None = None
    separator: str = "-"
    hash_required: bool = True
    valid_from: datetime | None = None
    valid_to: datetime | None = None


def _rule_value(rule: CaseRule) -> Column:
    first = F.col(rule.columns[0]).cast("string")
    if rule.kind in ("column", "correlation"):
        value = blank_to_null(first)
    elif rule.kind == "json_path":
        if rule.path is None:
            raise ValueError(f"rule {rule.rule_id} needs a path")
        value = blank_to_null(F.get_json_object(first, rule.path))
    elif rule.kind == "composite":
        parts = [blank_to_null(F.col(c).cast("string")) for c in rule.columns]
        complete = parts[0].isNotNull()
        for p in parts[1:]:
            complete = complete & p.isNotNull()
        value = F.when(complete, F.concat_ws(rule.separator, *parts))
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    ts = F.col("event_ts")
    if rule.valid_from is not None:
        value = F.when(ts >= moment(rule.valid_from), value)
    if rule.valid_to is not None:
        value = F.when(ts < moment(rule.valid_to), value)
    return value


def extract_case_id(events: DataFrame, rules: Sequence[CaseRule], key: bytes | None = None) -> DataFrame:
    """First rule by priority that yields a value gives ``case_id`` and ``case_rule_id``.

    Rules of lower priority are the fallback of those above. Plain column expressions, no join.
    """
    ordered = sorted(rules, key=lambda r: (-r.priority, r.rule_id))
    if key is None and any(r.hash_required for r in ordered):
        raise ValueError("a rule requires hashing but no key is available")
    values = [(r, _rule_value(r)) for r in ordered]
    case = F.coalesce(*[hmac_token(v, key) if r.hash_required else v for r, v in values])
    used = F.coalesce(*[F.when(v.isNotNull(), F.lit(r.rule_id)) for r, v in values])
    return events.withColumns({"case_id": case, "case_rule_id": used})


# Fields that identify an event without an id of its own.
FALLBACK_FIELDS = ("event_ts_raw", "source_class", "source_method", "request_id", "source_sequence")


def provisional_key(system: Column, raw_event_id: Column, fallback: Sequence[Column]) -> Column:
    """Source system and event id, or a hash of the identifying fields when there is no id."""
    by_id = F.when(blank_to_null(raw_event_id).isNotNull(), F.concat_ws(":", system, F.trim(raw_event_id)))
    filled = [F.coalesce(c.cast("string"), F.lit("<null>")) for c in fallback]
    return F.coalesce(by_id, F.sha2(F.concat_ws("|", *filled), 256))


def provisional_duplicates(events: DataFrame, key: str = "provisional_key") -> DataFrame:
    """Keys that occur more than once, with how often: the report on removable rows."""
    return events.groupBy(key).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def whitelist_attributes(events: DataFrame, source: str, paths: Mapping[str, str]) -> DataFrame:
    """Extract the named JSON values and drop the raw parameters."""
    extracted = {name: F.get_json_object(source, path) for name, path in paths.items()}
    return events.withColumns(extracted).drop(source)
