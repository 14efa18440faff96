"""Sources, profiling, normalization, quality and sinks over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomtrail.functions import privacy, timestamps
from loomtrail.functions.text import blank_to_null, whole_number
from loomtrail.operators import normalize as norm
from loomtrail.operators import quality
from loomtrail.operators.dfg import dfg_edges
from loomtrail.plans.dirty import BINDING, CHECKED, CONTRACT, DATASET, KEY, RAW, raw_log
from loomtrail.plans.logs import CASES, EDGE_COLUMNS, EDGES, STEPS, USER_LOG, user_log
from loomtrail.plans.registry import query, table, ts_text
from loomtrail.scale import ScalePolicy, stage, staged_path
from loomtrail.sources import drift, profile, readers, writers

SPLIT = ScalePolicy(max_group_rows=60)


def _csv_copy(spark, d, name, compression="none"):
    """The given table written as CSV, as raw material for the CSV readers."""
    path = staged_path(spark, f"csv-{name}")
    t = table(spark, d, name)
    shown = [
        F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.schema[c].dataType.typeName().startswith("timestamp") else F.col(c)
        for c in t.columns
    ]
    t.select(*shown).write.option("header", True).option("escape", '"').option("compression", compression).csv(path)
    return path


# --- scans -------------------------------------------------------------------------------------

_EVENTS_TEXT = """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events"""


@query("S01_csv_scan", _EVENTS_TEXT)
def _(spark, d):
    return readers.read_csv(spark, _csv_copy(spark, d, "events")).drop("value")


@query("S02_gzip_csv_scan", _EVENTS_TEXT)
def _(spark, d):
    return readers.read_csv_gz(spark, _csv_copy(spark, d, "events", "gzip")).drop("value")


@query("S01_csv_line_breaks", """SELECT doc_id AS row_id, md5(text) AS text_md5, length(text) AS n_chars, source,
  row_number() OVER (ORDER BY doc_id) AS source_row_number FROM documents""")
def _(spark, d):
    # Texts with line breaks and quotes, in one sorted run, so that row numbers follow from the ids.
    path = staged_path(spark, "documents-csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "source").repartitionByRange("doc_id")
    docs.sortWithinPartitions("doc_id").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_numbered_csv(spark, path).select(
        F.col("doc_id").cast("long").alias("row_id"), F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("n_chars"), "source", "source_row_number",
    )


@query("S03_parquet_scan", f"SELECT event_id, user_id, event_type, round(value, 6) AS value, {ts_text('ts')} AS ts FROM events")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/events.parquet").drop("props")


@query("S04_detect_schema", """SELECT CAST(row_number() OVER () AS INT) AS ordinal_position, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DOUBLE' THEN 'double'
       ELSE 'int' END AS inferred_type
FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM events))""")
def _(spark, d):
    return readers.detect_schema(spark, _csv_copy(spark, d, "events"), "CSV")


@query("S05_header_check", "SELECT column_name FROM (DESCRIBE SELECT * FROM orders)")
def _(spark, d):
    names = readers.check_header(spark, _csv_copy(spark, d, "orders"))
    return table(spark, d, "orders").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name")).distinct()


@query(
    "S06_typed_csv_load",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
  {ts_text('o_orderdate')} AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders""",
)
def _(spark, d):
    path = _csv_copy(spark, d, "orders")
    schema = table(spark, d, "orders").schema
    return (
        readers.read_typed_csv(spark, path, schema)
        .withColumn("event_date", F.to_date("o_orderdate"))
        .drop("o_orderpriority")
    )


@query(
    "S07_default_source",
    f"WITH {USER_LOG} SELECT event_id, source_event_id, case_id, activity FROM log",
)
def _(spark, d):
    return readers.default_source(user_log(spark, d)).events.select("event_id", "source_event_id", "case_id", "activity")


def _normalized(spark, d, policy=None):
    return norm.normalize(raw_log(spark, d), BINDING, CONTRACT, DATASET, KEY, **({"policy": policy} if policy else {}))


@query(
    "S08_normalized_source",
    f"""WITH {CHECKED} SELECT count(*) AS event_count, 'dataset=dirty-events' AS signature, 'mapping-v3' AS mapping_version,
  'dirty-events' AS dataset_id, 'contract-v1' AS contract_version, CAST(NULL AS VARCHAR) AS activity_mapping_version,
  'event-log-v1' AS normalization_version, 'source' AS activity_level FROM checked WHERE ok""",
)
def _(spark, d):
    path = writers.write_parquet(_normalized(spark, d).events, staged_path(spark, "canonical"))
    return readers.provenance(readers.normalized_source(spark, path, DATASET, BINDING.version, CONTRACT.version))


@query("S14_json_events", f"WITH {USER_LOG} SELECT event_id, case_id, activity, {ts_text('event_ts')} AS event_ts, ingest_sequence FROM log")
def _(spark, d):
    path = staged_path(spark, "json-events")
    log = user_log(spark, d).withColumn("event_ts", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    log.select("event_id", "case_id", "activity", "event_ts", "ingest_sequence").write.json(path)
    return readers.read_json_events(spark, path, multiline=False).drop("source_event_id")


# --- profiling ---------------------------------------------------------------------------------


def _profile_sql(name, columns):
    parts = [
        f"SELECT {i} AS ordinal_position, '{c}' AS column_name, count(*) AS row_count, "
        f"count_if({c} IS NULL) > 0 AS nullable_observed, count_if({c} IS NULL) AS null_count, "
        f"min({shown}) AS min_value, max({shown}) AS max_value FROM {name}"
        for i, (c, shown) in enumerate(columns, 1)
    ]
    return " UNION ALL ".join(parts)


_RAW_COLUMNS = [
    "raw_id", "raw_case", "raw_activity", "raw_ts", "raw_sequence", "raw_duration", "raw_status", "raw_user",
    "raw_method", "raw_system", "raw_department",
]


@query("R01_column_profile", f"WITH {RAW} " + _profile_sql("raw", [(c, c) for c in _RAW_COLUMNS]))
def _(spark, d):
    raw = raw_log(spark, d).drop("source_row_number")
    return profile.profile(raw).drop("approx_distinct", "sample_values", "inferred_type")


@query("X11_approx_distinct")
def _(spark, d):
    return profile.profile(table(spark, d, "orders")).select("column_name", "approx_distinct", "inferred_type")


@query(
    "X11_distinct_error",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact_distinct, true AS within_bound FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def _(spark, d):
    """The sketch stays within a sixth of the exact count."""
    orders = table(spark, d, "orders")
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("exact_distinct")) for c in orders.columns]
    exact = orders.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    return exact.join(profile.profile(orders), "column_name").select(
        "column_name",
        "exact_distinct",
        (F.abs(F.col("approx_distinct") - F.col("exact_distinct")) * 6 <= F.col("exact_distinct")).alias("within_bound"),
    )


@query("R02_source_size", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def _(spark, d):
    return profile.source_size(table(spark, d, "lineitem"))


@query(
    "R03_column_samples",
    """WITH firsts AS (SELECT row_number() OVER () AS nr, o_orderpriority AS v FROM orders LIMIT 20),
kinds AS (SELECT v, min(nr) AS nr FROM firsts GROUP BY v ORDER BY nr LIMIT 3)
SELECT 'o_orderpriority' AS column_name, string_agg(v, ',' ORDER BY nr) AS sample_values FROM kinds""",
)
def _(spark, d):
    samples = profile.profile(table(spark, d, "orders").select("o_orderpriority"))
    return samples.select("column_name", F.array_join("sample_values", ",").alias("sample_values"))


@query(
    "R04_nullable_observed",
    f"WITH {RAW} SELECT 'raw_case' AS column_name, count_if(raw_case IS NULL) > 0 AS nullable_observed FROM raw"
    " UNION ALL SELECT 'raw_user', count_if(raw_user IS NULL) > 0 FROM raw",
)
def _(spark, d):
    return profile.profile(raw_log(spark, d).select("raw_case", "raw_user")).select("column_name", "nullable_observed")


@query("R05_preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders LIMIT 200")
def _(spark, d):
    return profile.preview(table(spark, d, "orders"), 10_000).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "R06_rendered_values",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
  CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price,
  '<binary:' || strlen(o_orderpriority) || ' bytes>' AS priority FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return profile.rendered(
        o.select(
            "o_orderkey",
            "o_orderdate",
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
            F.encode("o_orderpriority", "UTF-8").alias("priority"),
        )
    )


@query(
    "R07_timestamp_preview",
    f"""WITH {CHECKED}, firsts AS (SELECT * FROM flagged WHERE raw_ts IS NOT NULL ORDER BY source_row_number LIMIT 5)
SELECT raw_ts AS source_value, strftime(utc, '%Y-%m-%d %H:%M:%S') || 'Z' AS utc_value,
  strftime(timezone('Asia/Seoul', timezone('UTC', utc)), '%Y-%m-%d %H:%M:%S') || ' Asia/Seoul' AS display_value,
  regexp_matches(trim(raw_ts), '(:[0-9]{{2}}[+-][0-9]{{2}}:[0-9]{{2}}|Z)$') AS timezone_aware FROM firsts""",
)
def _(spark, d):
    return profile.timestamp_preview(raw_log(spark, d), "raw_ts", "Asia/Seoul").drop("parsed_value")


_NAIVE = "coalesce(trim(raw_ts) <> '' AND NOT regexp_matches(trim(raw_ts), '(:[0-9]{2}[+-][0-9]{2}:[0-9]{2}|Z)$'), false)"


@query("R08_needs_source_timezone", f"WITH {RAW} SELECT bool_or({_NAIVE}) AS requires_source_timezone FROM raw")
def _(spark, d):
    return profile.needs_source_timezone(raw_log(spark, d), "raw_ts")


@query(
    "R08_aware_rows_only",
    f"WITH {RAW} SELECT bool_or({_NAIVE}) AS requires_source_timezone FROM raw WHERE raw_ts IS NULL OR raw_ts LIKE '%+09:00'",
)
def _(spark, d):
    rows = raw_log(spark, d).filter(F.col("raw_ts").isNull() | F.col("raw_ts").endswith("+09:00"))
    return profile.needs_source_timezone(rows, "raw_ts")


@query(
    "R09_pii_candidates",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS pii_kind, count_if(regexp_matches({c}, '{p}')) AS matching_rows,
  round(count_if(regexp_matches({c}, '{p}')) / CAST(count({c}) AS DOUBLE), 6) AS match_share,
  count_if(regexp_matches({c}, '{p}')) > 0 AS is_candidate FROM documents"""
        for c in ("text", "lang", "source")
        for kind, p in profile.PII_PATTERNS.items()
    ),
)
def _(spark, d):
    return profile.pii_candidates(table(spark, d, "documents").select("text", "lang", "source"))


# --- normalization -----------------------------------------------------------------------------


def _validated(spark, d, policy=None):
    return norm.validate(raw_log(spark, d), BINDING, CONTRACT, **({"policy": policy} if policy else {}))


@query(
    "N01_column_binding",
    f"""WITH {RAW} SELECT source_row_number, raw_case AS case_value, raw_activity AS activity_value, raw_ts AS timestamp_value,
  raw_id AS event_value, raw_user AS user_value, CAST(NULL AS VARCHAR) AS resource_value FROM raw""",
)
def _(spark, d):
    bound = norm.bind(raw_log(spark, d), BINDING)
    return bound.select(
        "source_row_number", "case_value", "activity_value", "timestamp_value", "event_value", "user_value", "resource_value"
    )


@query("N25_binding_checks", f"WITH {RAW} SELECT count(*) AS bound_rows FROM raw")
def _(spark, d):
    raw = raw_log(spark, d)
    BINDING.check(raw.columns)
    CONTRACT.check()
    return norm.bind(raw, BINDING).agg(F.count("*").alias("bound_rows"))


@query(
    "N02_tolerant_parse",
    f"""WITH {RAW} SELECT source_row_number, strftime(CASE WHEN raw_ts LIKE '%+09:00' THEN NULL ELSE try_cast(raw_ts AS TIMESTAMP) END,
  '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM raw""",
)
def _(spark, d):
    text = F.col("raw_ts")
    parsed = F.when(~text.endswith("+09:00"), timestamps.parse_local(text))
    return raw_log(spark, d).select("source_row_number", parsed.alias("parsed"))


@query(
    "N02_format_parse",
    f"""SELECT o_orderkey, {ts_text("try_strptime(strftime(o_orderdate, '%d/%m/%Y %H.%M'), '%d/%m/%Y %H.%M')")} AS parsed,
  {ts_text("try_strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')")} AS compact FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        timestamps.parse_local(F.date_format("o_orderdate", "dd/MM/yyyy HH.mm"), "%d/%m/%Y %H.%M").alias("parsed"),
        timestamps.parse_local(F.date_format("o_orderdate", "yyyyMMdd"), "%Y%m%d").alias("compact"),
    )


@query(
    "N03_aware_detection",
    f"""WITH {RAW} SELECT regexp_matches(trim(raw_ts), '(:[0-9]{{2}}[+-][0-9]{{2}}:[0-9]{{2}}|Z)$') AS timezone_aware,
  count(*) AS n FROM raw WHERE raw_ts IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    raw = raw_log(spark, d).filter(F.col("raw_ts").isNotNull())
    return raw.groupBy(timestamps.is_aware(F.col("raw_ts")).alias("timezone_aware")).agg(F.count("*").alias("n"))


@query("N04_utc_normalization", f"WITH {CHECKED} SELECT source_row_number, {ts_text('utc')} AS event_ts FROM flagged")
def _(spark, d):
    return raw_log(spark, d).select(
        "source_row_number", timestamps.parse_utc(F.col("raw_ts"), "Asia/Seoul").alias("event_ts")
    )


@query(
    "N05_display_zone",
    f"""WITH {USER_LOG} SELECT event_id,
  strftime(timezone('America/New_York', timezone('UTC', event_ts)), '%Y-%m-%d %H:%M:%S') || ' America/New_York' AS shown FROM log""",
)
def _(spark, d):
    return user_log(spark, d).select("event_id", timestamps.in_zone(F.col("event_ts"), "America/New_York").alias("shown"))


@query("N06_format_and_zone_checks", "SELECT count(*) AS rows_to_parse FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    timestamps.check_format(spark, "%d/%m/%Y %H.%M")
    timestamps.check_timezone(spark, "Asia/Seoul")
    return orders.agg(F.count("o_orderdate").alias("rows_to_parse"))


@query(
    "N06_settings_from_data",
    """SELECT DISTINCT o_orderpriority AS setting, false AS accepted FROM orders
UNION ALL SELECT DISTINCT CASE o_orderstatus WHEN 'O' THEN 'Asia/Seoul' ELSE 'Nowhere/' || o_orderstatus END, o_orderstatus = 'O' FROM orders""",
)
def _(spark, d):
    """Zone names as the data give them: only real ones pass."""
    named = F.when(F.col("o_orderstatus") == "O", "Asia/Seoul").otherwise(F.concat(F.lit("Nowhere/"), "o_orderstatus"))
    orders = table(spark, d, "orders")
    settings = orders.select(F.explode(F.array("o_orderpriority", named)).alias("setting")).distinct()

    def accepted(zone):
        try:
            timestamps.check_timezone(spark, zone)
        except ValueError:
            return False
        return True

    good = [r["setting"] for r in settings.collect() if accepted(r["setting"])]
    return settings.select("setting", F.col("setting").isin(*good).alias("accepted"))


@query("N07_row_number_parquet", "SELECT event_id, row_number() OVER () AS source_row_number FROM events")
def _(spark, d):
    return readers.number_parquet_rows(spark, f"{d}/events.parquet").select("event_id", "source_row_number")


@query("N07_row_number_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, row_number() OVER () AS source_row_number FROM events")
def _(spark, d):
    rows = readers.read_csv(spark, _csv_copy(spark, d, "events"))
    return readers.number_rows(rows).select("event_id", "source_row_number")


_FLAGS = """null_case_id, empty_case_id, null_activity, empty_activity, null_timestamp, empty_timestamp, invalid_timestamp"""


@query("N08_technical_flags", f"WITH {CHECKED} SELECT source_row_number, {_FLAGS} FROM flagged")
def _(spark, d):
    flagged = norm.flag_values(norm.bind(raw_log(spark, d), BINDING), CONTRACT)
    return flagged.select("source_row_number", *[f.strip() for f in _FLAGS.split(",")])


_DUPLICATES = f"WITH {CHECKED} SELECT source_row_number, duplicate_event FROM flagged"


@query("N09_duplicate_events", _DUPLICATES)
def _(spark, d):
    return _validated(spark, d).select("source_row_number", "duplicate_event")


_SAME_TIME = f"WITH {CHECKED} SELECT source_row_number, same_timestamp_count, duplicate_timestamp FROM flagged"


@query("N10_same_timestamp", _SAME_TIME)
def _(spark, d):
    return _validated(spark, d).select("source_row_number", "same_timestamp_count", "duplicate_timestamp")


@query("W03_group_counts_split", f"WITH {CHECKED} SELECT source_row_number, duplicate_event, same_timestamp_count, duplicate_timestamp FROM flagged")
def _(spark, d):
    return _validated(spark, d, SPLIT).select(
        "source_row_number", "duplicate_event", "same_timestamp_count", "duplicate_timestamp"
    )


@query("N11_validity", f"WITH {CHECKED} SELECT source_row_number, ok AS is_valid FROM checked")
def _(spark, d):
    return _validated(spark, d).select("source_row_number", "is_valid")


_CODES = """concat_ws('|', CASE WHEN null_case_id THEN 'NULL_CASE_ID' END, CASE WHEN empty_case_id THEN 'EMPTY_CASE_ID' END,
  CASE WHEN null_activity THEN 'NULL_ACTIVITY' END, CASE WHEN empty_activity THEN 'EMPTY_ACTIVITY' END,
  CASE WHEN null_timestamp THEN 'NULL_TIMESTAMP' END, CASE WHEN empty_timestamp THEN 'EMPTY_TIMESTAMP' END,
  CASE WHEN invalid_timestamp THEN 'INVALID_TIMESTAMP' END, CASE WHEN duplicate_event THEN 'DUPLICATE_EVENT' END)"""
_QUARANTINE = f"""WITH {CHECKED} SELECT source_row_number, {_CODES} AS failure_code,
  'Technical event-log validation failed' AS failure_reason, 'dirty-events' AS dataset_id, 3 AS mapping_version
FROM checked WHERE NOT ok"""


@query("N12_failure_codes", f"WITH {CHECKED} SELECT {_CODES} AS failure_code, count(*) AS n FROM checked WHERE NOT ok GROUP BY 1")
def _(spark, d):
    return norm.quarantine(_validated(spark, d), BINDING, DATASET).groupBy("failure_code").agg(F.count("*").alias("n"))


_INNER, _OUTER = privacy.hmac_pads(KEY)


def _hmac_sql(text, inner=_INNER, outer=_OUTER):
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({text}))))"


@query("N13_hmac_token", f"WITH {USER_LOG} SELECT DISTINCT case_id, {_hmac_sql('case_id')} AS token FROM log")
def _(spark, d):
    ids = user_log(spark, d).select("case_id").distinct()
    return ids.select("case_id", privacy.hmac_token(F.col("case_id"), KEY).alias("token"))


@query(
    "N14_retention",
    f"""WITH {RAW} SELECT source_row_number, {_hmac_sql('raw_user')} AS user_token, nullif(trim(raw_system), '') AS kept_system,
  CAST(NULL AS VARCHAR) AS dropped FROM raw""",
)
def _(spark, d):
    bound = norm.bind(raw_log(spark, d), BINDING)
    rules = CONTRACT.resolve(BINDING)
    return bound.select(
        "source_row_number",
        norm.retained("user", "user_value", rules["user"], KEY).alias("user_token"),
        norm.retained("system", "system_value", rules["system"], KEY).alias("kept_system"),
        norm.retained("department", "department_value", rules["department"], KEY).alias("dropped"),
    )


@query(
    "N15_policy_defaults",
    f"""WITH {RAW} SELECT DISTINCT name, policy FROM raw, (VALUES ('department', 'DROP'), ('duration', 'KEEP'), ('event_id', 'KEEP'),
  ('method', 'KEEP'), ('resource', 'DROP'), ('source_sequence', 'KEEP'), ('status', 'KEEP'), ('system', 'KEEP'),
  ('user', 'PSEUDONYMIZE')) AS p(name, policy)""",
)
def _(spark, d):
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(str(p)).alias("policy")) for n, p in CONTRACT.resolve(BINDING).items()])
    return raw_log(spark, d).select(F.inline(rules)).distinct()


_CANONICAL = f"""WITH {CHECKED} SELECT
  coalesce(own_id, sha256('dirty-events:' || CAST(source_row_number AS VARCHAR))) AS event_id,
  {_hmac_sql('trim(raw_case)')} AS case_id, trim(raw_activity) AS activity, {ts_text('utc')} AS event_ts,
  CAST(NULL AS VARCHAR) AS process_domain, coalesce(nullif(trim(raw_system), ''), 'uploaded_file') AS source_system,
  CAST(NULL AS VARCHAR) AS source_class, raw_method AS source_method, CAST(NULL AS VARCHAR) AS module,
  CAST(NULL AS VARCHAR) AS lifecycle, CAST(NULL AS VARCHAR) AS org_code, CAST(NULL AS VARCHAR) AS actor_hash,
  trim(raw_status) AS result_code, try_cast(raw_duration AS BIGINT) AS duration_ms,
  try_cast(raw_sequence AS BIGINT) AS source_sequence, source_row_number AS ingest_sequence,
  'mapping-v3' AS mapping_version, 'case-column-v3' AS case_rule_version, 'dirty-events' AS ingestion_batch_id,
  strftime(utc, '%Y-%m-%d') AS event_date, 'Asia/Seoul' AS source_timezone, own_id AS source_event_id,
  CAST(NULL AS VARCHAR) AS resource, {_hmac_sql('raw_user')} AS user
FROM checked WHERE ok"""


@query("N16_event_id_fallback", f"WITH {CHECKED} SELECT coalesce(own_id, sha256('dirty-events:' || CAST(source_row_number AS VARCHAR))) AS event_id, own_id AS source_event_id FROM checked WHERE ok")
def _(spark, d):
    return norm.canonical_events(_validated(spark, d), BINDING, CONTRACT, DATASET, KEY).select("event_id", "source_event_id")


@query(
    "N17_tolerant_numbers",
    f"WITH {RAW} SELECT source_row_number, try_cast(raw_duration AS BIGINT) AS duration_ms, try_cast(raw_sequence AS BIGINT) AS source_sequence FROM raw",
)
def _(spark, d):
    return raw_log(spark, d).select(
        "source_row_number",
        whole_number(F.col("raw_duration")).alias("duration_ms"),
        whole_number(F.col("raw_sequence")).alias("source_sequence"),
    )


@query(
    "N17_decimal_text",
    "SELECT event_id, try_cast(CAST(value AS VARCHAR) AS BIGINT) AS whole FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", whole_number(F.col("value").cast("string")).alias("whole"))


@query("N18_canonical_projection", _CANONICAL)
def _(spark, d):
    return norm.canonical_events(_validated(spark, d), BINDING, CONTRACT, DATASET, KEY)


@query(
    "N19_normalize_log",
    f"""WITH {CHECKED} SELECT count(*) AS total_rows, count_if(ok) AS valid_rows, count_if(NOT ok) AS quarantined_rows FROM checked""",
)
def _(spark, d):
    log = _normalized(spark, d)
    return log.validated.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        log.events.agg(F.count("*").alias("n")).scalar().alias("valid_rows"),
        log.quarantine.agg(F.count("*").alias("n")).scalar().alias("quarantined_rows"),
    )


@query(
    "N19_dfg_of_normalized_log",
    f"""WITH {CHECKED}, log AS (SELECT trim(raw_case) AS case_id, trim(raw_activity) AS activity, utc AS event_ts,
  try_cast(raw_sequence AS BIGINT) AS source_sequence, own_id AS source_event_id, source_row_number AS ingest_sequence
  FROM checked WHERE ok), {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges""",
)
def _(spark, d):
    return dfg_edges(_normalized(spark, d).events)


# --- sinks -------------------------------------------------------------------------------------


@query("S09_canonical_sink", _CANONICAL)
def _(spark, d):
    path = writers.write_parquet(_normalized(spark, d).events, staged_path(spark, "canonical"))
    return spark.read.parquet(path)


@query("S10_quarantine_sink", _QUARANTINE)
def _(spark, d):
    path = writers.write_parquet(_normalized(spark, d).quarantine, staged_path(spark, "quarantine"))
    return spark.read.parquet(path)


@query("S11_staged_validation", f"WITH {CHECKED} SELECT source_row_number, ok AS is_valid, duplicate_event FROM checked")
def _(spark, d):
    return _normalized(spark, d).validated.select("source_row_number", "is_valid", "duplicate_event")


@query(
    "S12_published_version",
    f"WITH {CHECKED} SELECT count(*) AS event_count, count(DISTINCT raw_case) AS case_count, 2 AS versions FROM checked WHERE ok",
)
def _(spark, d):
    root = staged_path(spark, "published")
    log = _normalized(spark, d)
    writers.publish(spark, log, root, DATASET, 1)
    writers.publish(spark, log, root, DATASET, 2)
    versions = writers.publications(spark, root, DATASET).agg(F.count("*").cast("int").alias("n")).scalar()
    return (
        writers.current_events(spark, root, DATASET)
        .agg(F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"))
        .withColumn("versions", versions)
    )


@query(
    "S13_partitioned_layout",
    f"""WITH {USER_LOG} SELECT process_domain, CAST(year(event_ts) AS INT) AS year, CAST(month(event_ts) AS INT) AS month,
  strftime(event_ts, '%Y-%m-%d') AS event_date, count(*) AS event_count FROM log GROUP BY ALL""",
)
def _(spark, d):
    log = user_log(spark, d).withColumns(
        {"year": F.year("event_ts"), "month": F.month("event_ts"), "event_date": F.to_date("event_ts")}
    )
    by = ["process_domain", "year", "month", "event_date"]
    path = writers.write_partitioned(log, staged_path(spark, "layout"), by)
    return spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("event_count"))


# --- quality -----------------------------------------------------------------------------------

_REPORT = f"""{CHECKED}, sizes AS (SELECT trim(raw_case) AS c, count(*) AS n,
    bool_or(duplicate_timestamp AND try_cast(raw_sequence AS BIGINT) IS NULL AND own_id IS NULL) AS amb
  FROM checked WHERE ok GROUP BY 1),
report AS (SELECT 'dirty-events' AS dataset_id, 3 AS mapping_version, count(*) AS total_rows, count_if(ok) AS valid_events,
  count_if(NOT ok) AS invalid_events, count_if(null_case_id) AS null_case_id, count_if(empty_case_id) AS empty_case_id,
  count_if(null_activity) AS null_activity, count_if(empty_activity) AS empty_activity,
  count_if(null_timestamp) AS null_timestamp, count_if(empty_timestamp) AS empty_timestamp,
  count_if(invalid_timestamp) AS invalid_timestamp, count_if(duplicate_event) AS duplicate_events,
  count_if(duplicate_timestamp) AS duplicate_timestamp_rows,
  (SELECT count(*) FROM sizes) AS unique_cases, (SELECT count_if(n = 1) FROM sizes) AS single_event_cases,
  (SELECT count_if(amb) FROM sizes) AS ambiguous_ordering_cases, (SELECT min(n) FROM sizes) AS events_per_case_min,
  (SELECT max(n) FROM sizes) AS events_per_case_max, (SELECT count_if(n > 60) FROM sizes) AS extremely_large_cases,
  count(DISTINCT trim(raw_activity)) FILTER (WHERE ok) AS unique_activities,
  (SELECT round(quantile_cont(n, 0.5), 6) FROM sizes) AS events_per_case_median,
  (SELECT round(quantile_cont(n, 0.9), 6) FROM sizes) AS events_per_case_p90,
  'PASSED_WITH_QUARANTINE' AS outcome,
  CASE WHEN (SELECT bool_or(amb) FROM sizes) THEN 'WARNING_AMBIGUOUS_ORDERING' ELSE 'PASSED' END AS semantic_quality
FROM checked)"""


def _report(spark, d, policy=None):
    checked = stage(_validated(spark, d, policy), "validated-rows")
    more = {"policy": policy} if policy else {}
    return quality.quality_report(checked, DATASET, BINDING.version, 60, **more)


@query("A13_quality_report", f"WITH {_REPORT} FROM report")
def _(spark, d):
    return _report(spark, d)


@query("A13_quality_report_split", f"WITH {_REPORT} FROM report")
def _(spark, d):
    return _report(spark, d, SPLIT)


@query("A14_outcomes", f"WITH {_REPORT} SELECT outcome, semantic_quality FROM report")
def _(spark, d):
    return _report(spark, d).select("outcome", "semantic_quality")


_SEVERITY = " UNION ALL ".join(
    f"SELECT dataset_id, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value, "
    + ("'neutral'" if m in ("total_rows", "unique_cases", "unique_activities", "single_event_cases")
       else "'good'" if m == "valid_events" else f"CASE WHEN {m} > 0 THEN 'warning' ELSE 'good' END")
    + " AS severity FROM report"
    for m in quality.METRIC_VIEWS
)


@query("T04_metric_views", f"WITH {_REPORT} {_SEVERITY}")
def _(spark, d):
    return quality.metric_views(_report(spark, d))


_BOUNDS = {"earliest": datetime(2024, 1, 2), "latest": datetime(2024, 1, 29)}


def _loaded(spark, d):
    """Bound rows before rejection, in canonical names."""
    flagged = norm.flag_values(norm.bind(raw_log(spark, d), BINDING), CONTRACT)
    return flagged.select(
        blank_to_null(F.col("case_value")).alias("case_id"),
        blank_to_null(F.col("activity_value")).alias("activity"),
        F.col("parsed_ts").alias("event_ts"),
        whole_number(F.col("duration_value")).alias("duration_ms"),
    )


_LOAD = f"""{CHECKED}, loaded AS (SELECT nullif(trim(raw_case), '') AS case_id, nullif(trim(raw_activity), '') AS activity,
  utc AS event_ts, try_cast(raw_duration AS BIGINT) AS duration_ms FROM flagged),
per AS (SELECT case_id, count(*) AS n FROM loaded WHERE case_id IS NOT NULL GROUP BY 1),
rates AS (SELECT count(*) AS total_rows, count_if(event_ts IS NULL) / CAST(count(*) AS DOUBLE) AS missing_timestamp_rate,
  count_if(case_id IS NULL) / CAST(count(*) AS DOUBLE) AS missing_case_rate,
  count_if(activity IS NULL) / CAST(count(*) AS DOUBLE) AS unmapped_activity_rate, CAST(0 AS BIGINT) AS ambiguous_mapping_count,
  count_if(event_ts < TIMESTAMP '2024-01-02' OR event_ts >= TIMESTAMP '2024-01-29') AS timestamp_outlier_count,
  count_if(duration_ms < 0) AS invalid_duration_count,
  (SELECT count_if(n = 1) / CAST(count(*) AS DOUBLE) FROM per) AS case_single_event_rate,
  (SELECT count_if(n > 70) / CAST(count(*) AS DOUBLE) FROM per) AS case_extreme_length_rate FROM loaded)"""
_RATES = ("missing_timestamp_rate", "missing_case_rate", "unmapped_activity_rate", "case_single_event_rate", "case_extreme_length_rate")


def _load_metrics(spark, d):
    return quality.load_metrics(
        _loaded(spark, d), large_case_events=70, unmapped=F.col("activity").isNull(), **_BOUNDS
    )


@query(
    "A18_load_metrics",
    f"WITH {_LOAD} SELECT * REPLACE ({', '.join(f'round({r}, 6) AS {r}' for r in _RATES)}) FROM rates",
)
def _(spark, d):
    return _load_metrics(spark, d)


@query(
    "T01_timestamp_quality",
    f"""WITH {CHECKED}, aware AS (SELECT *, regexp_matches(trim(raw_ts), '(:[0-9]{{2}}[+-][0-9]{{2}}:[0-9]{{2}}|Z)$') AS zoned FROM flagged)
SELECT count(*) AS total_rows, count_if(invalid_timestamp) AS parse_failures,
  count_if(utc >= TIMESTAMP '2024-01-29') AS future_outliers, count_if(utc < TIMESTAMP '2024-01-02') AS old_outliers,
  count_if(utc IS NOT NULL AND zoned) AS zoned_rows, count_if(utc IS NOT NULL AND NOT zoned) AS unzoned_rows,
  round(count_if(invalid_timestamp) / CAST(count(*) AS DOUBLE), 6) AS parse_failure_rate, true AS zone_mismatch FROM aware""",
)
def _(spark, d):
    flagged = norm.flag_values(norm.bind(raw_log(spark, d), BINDING), CONTRACT)
    return quality.timestamp_quality(flagged, aware=timestamps.is_aware(F.col("timestamp_value")), **_BOUNDS)


@query(
    "T02_duration_quality",
    f"""WITH {USER_LOG}, {CASES} SELECT (SELECT count(*) FROM log) AS event_count,
  (SELECT count_if(duration_ms < 0) FROM log) AS negative_durations, min(n) AS shortest_case, max(n) AS longest_case,
  count_if(n > 70) AS oversized_cases FROM cases""",
)
def _(spark, d):
    return quality.duration_quality(user_log(spark, d), 70)


_GATES = {
    "missing_timestamp_rate": (0.01, 0.05),
    "missing_case_rate": (0.05, 0.10),
    "unmapped_activity_rate": (0.001, 0.01),
    "ambiguous_mapping_count": (0.0, 0.0),
}


@query(
    "T03_quality_gate",
    f"""WITH {_LOAD}, long AS ({' UNION ALL '.join(
        f"SELECT '{m}' AS metric_name, round(CAST({m} AS DOUBLE), 6) AS metric_value, CAST({w} AS DOUBLE) AS w, CAST({x} AS DOUBLE) AS threshold_value FROM rates"
        for m, (w, x) in _GATES.items())})
SELECT 'dirty-events' AS ingestion_batch_id, metric_name, metric_value, threshold_value,
  CASE WHEN metric_value > threshold_value THEN 'FAIL' WHEN metric_value > w THEN 'WARN' ELSE 'PASS' END AS status FROM long""",
)
def _(spark, d):
    row = _load_metrics(spark, d).withColumn("ingestion_batch_id", F.lit(DATASET))
    return quality.gate(quality.melt(row, ["ingestion_batch_id"], list(_GATES)), _GATES)


@query(
    "V05_manifest_drift",
    """WITH a AS (SELECT o_orderkey AS path, o_custkey AS size FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey AS path, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 13 <> 0)
SELECT path, CASE WHEN b.path IS NULL THEN 'MISSING' WHEN a.path IS NULL THEN 'NEW' WHEN a.size = b.size THEN 'UNCHANGED' ELSE 'CHANGED' END AS drift
FROM a FULL JOIN b USING (path)""",
)
def _(spark, d):
    """Two manifests over one key: what went, came, changed or stayed."""
    orders = table(spark, d, "orders")
    key, size = F.col("o_orderkey"), F.col("o_custkey")
    old = orders.filter(key % 11 != 0).select(key.alias("path"), size.alias("size_bytes"))
    grown = size + F.when(key % 7 == 0, 1).otherwise(0)
    now = orders.filter(key % 13 != 0).select(key.alias("path"), grown.alias("size_bytes"))
    return drift.source_drift(now, old)


@query("V05_changed_ranges", "SELECT 'CHANGED' AS drift, count(*) AS n_ranges FROM events WHERE event_id = 100")
def _(spark, d):
    # The same rows twice, with one date changed in the second copy.
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type")
    moved = F.when(F.col("event_id") == 100, F.concat(F.lit("1999"), F.substr("ts", F.lit(5)))).otherwise(F.col("ts"))
    found = []
    for rows in (e, e.withColumn("ts", moved)):
        path = staged_path(spark, "checked")
        rows.repartition(4, "event_id").sortWithinPartitions("event_id").write.csv(path)
        ranges = drift.range_checksums(spark, path, 4096)
        found.append(ranges.withColumn("path", F.regexp_extract("path", r"part-(\d+)", 1)))
    return drift.changed_ranges(found[1], found[0]).groupBy("drift").agg(F.count("*").alias("n_ranges"))


@query("V05_source_drift")
def _(spark, d):
    """All table files against a manifest in which events has another size and orders is missing."""
    now = drift.file_listing(spark, f"{d}/*.parquet").select("path", "size_bytes")
    old = now.filter(~F.col("path").endswith("/orders.parquet")).withColumn(
        "size_bytes", F.when(F.col("path").endswith("/events.parquet"), 1).otherwise(F.col("size_bytes"))
    )
    return drift.source_drift(now, old).withColumn("path", F.substring_index("path", "/", -1))


