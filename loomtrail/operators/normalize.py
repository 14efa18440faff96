"""Raw rows -> canonical event log, quarantine and quality report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.privacy import hmac_token
from loomtrail.functions.text import blank_to_null, whole_number
from loomtrail.functions.timestamps import parse_utc
from loomtrail.model import (
    CANONICAL_SCHEMA,
    LARGE_CASE_EVENTS,
    OPTIONAL_ATTRIBUTES,
    ColumnBinding,
    Retention,
    SemanticContract,
)
from loomtrail.operators.quality import quality_report
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, stage

ROW_NUMBER = "source_row_number"

# Failure codes in the order in which they are joined.
FAILURES = (
    ("null_case_id", "NULL_CASE_ID"),
    ("empty_case_id", "EMPTY_CASE_ID"),
    ("null_activity", "NULL_ACTIVITY"),
    ("empty_activity", "EMPTY_ACTIVITY"),
    ("null_timestamp", "NULL_TIMESTAMP"),
    ("empty_timestamp", "EMPTY_TIMESTAMP"),
    ("invalid_timestamp", "INVALID_TIMESTAMP"),
    ("duplicate_event", "DUPLICATE_EVENT"),
)
# Fixed value: the only reason text a rejected row carries.
FAILURE_REASON = "Technical event-log validation failed"


def bind(raw: DataFrame, binding: ColumnBinding) -> DataFrame:
    """Source columns as text under their logical names; unbound ones are NULL."""
    binding.check(raw.columns)

    def text(source: str | None, name: str) -> Column:
        column = F.lit(None) if source is None else F.col(f"`{source}`")
        return column.cast("string").alias(f"{name}_value")

    return raw.select(
        F.col(ROW_NUMBER),
        text(binding.case_id, "case"),
        text(binding.activity, "activity"),
        text(binding.timestamp, "timestamp"),
        text(binding.event_id, "event"),
        *[text(binding.optional.get(name), name) for name in OPTIONAL_ATTRIBUTES],
    )


def flag_values(bound: DataFrame, contract: SemanticContract, fmt: str | None = None) -> DataFrame:
    """Parsed timestamp and one flag per single-row failure."""
    case, activity, ts = F.col("case_value"), F.col("activity_value"), F.col("timestamp_value")
    parsed = bound.withColumn("parsed_ts", parse_utc(ts, contract.source_timezone, fmt))
    blank_ts = ts.isNotNull() & (F.trim(ts) == "")
    return parsed.select(
        "*",
        case.isNull().alias("null_case_id"),
        (case.isNotNull() & (F.trim(case) == "")).alias("empty_case_id"),
        activity.isNull().alias("null_activity"),
        (activity.isNotNull() & (F.trim(activity) == "")).alias("empty_activity"),
        ts.isNull().alias("null_timestamp"),
        blank_ts.alias("empty_timestamp"),
        (ts.isNotNull() & ~blank_ts & F.col("parsed_ts").isNull()).alias("invalid_timestamp"),
    )


def _duplicate_key(flagged: DataFrame) -> DataFrame:
    """An event id identifies a row on its own; without one, case, activity and time do."""
    event = blank_to_null(F.col("event_value"))
    return flagged.select(
        "*",
        event.alias("_k_event"),
        F.when(event.isNull(), F.trim("case_value")).alias("_k_case"),
        F.when(event.isNull(), F.trim("activity_value")).alias("_k_activity"),
        F.when(event.isNull(), F.col("parsed_ts")).alias("_k_ts"),
    )


_DUPLICATE_KEYS = ["_k_event", "_k_case", "_k_activity", "_k_ts"]
_MOMENT_KEYS = ["case_value", "parsed_ts"]


def _count_by_join(df: DataFrame, source: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Group size per row. Counting combines before the shuffle, and only repeated keys are joined
    back, so a key that holds most rows never meets in one task unless it really repeats there;
    adaptive execution splits such a partition of the row side."""
    sizes = source.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)
    other = sizes.select(*[F.col(k).alias(f"r{k}") for k in keys], name)
    same = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
    joined = df.join(other, same, "left").drop(*[f"r{k}" for k in keys])
    return joined.withColumn(name, F.coalesce(name, F.lit(1)))


def flag_repeats(flagged: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Flags that need other rows: ``duplicate_event`` (every member of a group of equal events)
    and ``duplicate_timestamp`` (several events of a case at one moment, a signal only)."""
    keyed = _duplicate_key(flagged)
    # The counts read the key columns only; the rows themselves are not written for them.
    counted = _count_by_join(keyed, keyed, _DUPLICATE_KEYS, "duplicate_count")
    counted = _count_by_join(counted, keyed, _MOMENT_KEYS, "same_timestamp_count")
    case = F.col("case_value")
    return counted.select(
        *flagged.columns,
        "same_timestamp_count",
        (F.col("duplicate_count") > 1).alias("duplicate_event"),
        (
            case.isNotNull()
            & (F.trim(case) != "")
            & F.col("parsed_ts").isNotNull()
            & (F.col("same_timestamp_count") > 1)
        ).alias("duplicate_timestamp"),
    )


def is_valid() -> Column:
    bad = F.lit(False)
    for flag, _ in FAILURES:
        bad = bad | F.col(flag)
    return ~bad & F.col("parsed_ts").isNotNull()


def failure_codes() -> Column:
    """Codes of all failed checks joined by ``|`` in fixed order."""
    return F.concat_ws("|", *[F.when(F.col(flag), code) for flag, code in FAILURES])


def validate(
    raw: DataFrame,
    binding: ColumnBinding,
    contract: SemanticContract = SemanticContract(),
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Bound rows with every flag and ``is_valid``. ``raw`` carries ``source_row_number``."""
    contract.check()
    flagged = flag_values(bind(raw, binding), contract, binding.timestamp_format)
    return flag_repeats(flagged, policy).withColumn("is_valid", is_valid())


def retained(name: str, value: str, policy: Retention, key: bytes | None) -> Column:
    """Attribute under its retention policy; blank text becomes NULL."""
    text = blank_to_null(F.col(value))
    if policy == Retention.DROP:
        return F.lit(None).cast("string")
    if policy == Retention.PSEUDONYMIZE:
        if key is None:
            raise ValueError(f"attribute {name} is pseudonymized but no key is available")
        return hmac_token(text, key)
    return text


def canonical_events(
    validated: DataFrame,
    binding: ColumnBinding,
    contract: SemanticContract,
    dataset_id: str,
    key: bytes | None = None,
) -> DataFrame:
    """Valid rows in the canonical schema, stamped with mapping and case-rule versions."""
    rules = contract.resolve(binding)
    if contract.pseudonymize_case_id and key is None:
        raise ValueError("case ids are pseudonymized but no key is available")

    def attribute(name: str) -> Column:
        return retained(name, f"{name}_value", rules[name], key)

    def number(name: str) -> Column:
        dropped = rules[name] == Retention.DROP
        return F.lit(None).cast("bigint") if dropped else whole_number(F.col(f"{name}_value"))

    case = F.trim("case_value")
    source_event = retained("event_id", "event_value", rules["event_id"], key)
    none = F.lit(None).cast("string")
    fallback_id = F.sha2(F.concat_ws(":", F.lit(dataset_id), F.col(ROW_NUMBER).cast("string")), 256)
    columns = {
        "event_id": F.coalesce(source_event, fallback_id),
        "case_id": hmac_token(case, key) if contract.pseudonymize_case_id else case,
        "activity": F.trim("activity_value"),
        "event_ts": F.col("parsed_ts"),
        "process_domain": none,
        "source_system": F.coalesce(attribute("system"), F.lit("uploaded_file")),
        "source_class": none,
        "source_method": attribute("method"),
        "module": none,
        "lifecycle": none,
        "org_code": attribute("department"),
        "actor_hash": none,
        "result_code": attribute("status"),
        "duration_ms": number("duration"),
        "source_sequence": number("source_sequence"),
        "ingest_sequence": F.col(ROW_NUMBER).cast("bigint"),
        "mapping_version": F.lit(f"mapping-v{binding.version}"),
        "case_rule_version": F.lit(f"case-column-v{binding.version}"),
        "ingestion_batch_id": F.lit(dataset_id),
        "event_date": F.col("parsed_ts").cast("date"),
        "source_timezone": F.lit(contract.source_timezone),
        "source_event_id": source_event,
        "resource": attribute("resource"),
        "user": attribute("user"),
    }
    return validated.filter("is_valid").select(*[columns[f.name].alias(f.name) for f in CANONICAL_SCHEMA.fields])


def quarantine(validated: DataFrame, binding: ColumnBinding, dataset_id: str) -> DataFrame:
    """Row number and failure codes of rejected rows; never a raw value."""
    return validated.filter(~F.col("is_valid")).select(
        F.col(ROW_NUMBER),
        failure_codes().alias("failure_code"),
        F.lit(FAILURE_REASON).alias("failure_reason"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(binding.version).alias("mapping_version"),
    )


@dataclass(frozen=True)
class NormalizedLog:
    events: DataFrame
    quarantine: DataFrame
    quality: DataFrame
    validated: DataFrame


def normalize(
    raw: DataFrame,
    binding: ColumnBinding,
    contract: SemanticContract,
    dataset_id: str,
    key: bytes | None = None,
    large_case_events: int = LARGE_CASE_EVENTS,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> NormalizedLog:
    """Validate once into a staged table, then derive its three consumers from it."""
    checked = stage(validate(raw, binding, contract, policy), "validated-rows")
    return NormalizedLog(
        events=canonical_events(checked, binding, contract, dataset_id, key),
        quarantine=quarantine(checked, binding, dataset_id),
        quality=quality_report(checked, dataset_id, binding.version, large_case_events, policy),
        validated=checked,
    )
