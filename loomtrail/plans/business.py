"""Business mapping, rules, registries, comparison and stored aggregates over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomtrail.functions import privacy
from loomtrail.functions.timing import moment
from loomtrail.model import EventFilter, UnmappedPolicy
from loomtrail.operators import caserules, compare, layers, ledger, mapping, versions
from loomtrail.operators.dfg import dfg_edges
from loomtrail.operators.filters import filter_signature, in_range
from loomtrail.plans.dirty import BINDING, CHECKED, DATASET, KEY
from loomtrail.plans.exploration import JAN_20, is_failed
from loomtrail.plans.ingestion import _hmac_sql, _normalized
from loomtrail.plans.logs import CASES, DAY_LOG, EDGE_COLUMNS, EDGES, STEPS, TRACES, USER_LOG, day_log, user_log
from loomtrail.plans.registry import ORACLES, query, table, ts_text
from loomtrail.scale import stage, staged_path

# --- mapping sets ------------------------------------------------------------------------------


def entries(spark, d):
    """Mapping set derived from the activities found in the log; signup stays unmapped."""
    known = user_log(spark, d).select(F.col("activity").alias("source_activity")).distinct()
    label = (
        F.when(F.col("source_activity").isin("click", "view"), "Browse")
        .when(F.col("source_activity") == "purchase", "Order")
        .when(F.col("source_activity") == "error", "Incident")
    )
    return known.select(
        "source_activity",
        F.coalesce(label, F.lit("Join")).alias("business_activity"),
        F.when(F.col("source_activity").isin("click", "view", "purchase"), "Sales").otherwise("Other").alias("activity_group"),
        (F.col("source_activity") != "signup").alias("enabled"),
    )


_ENTRIES = """entries AS (SELECT DISTINCT activity AS source_activity,
  CASE WHEN activity IN ('click', 'view') THEN 'Browse' WHEN activity = 'purchase' THEN 'Order'
       WHEN activity = 'error' THEN 'Incident' ELSE 'Join' END AS business_activity,
  CASE WHEN activity IN ('click', 'view', 'purchase') THEN 'Sales' ELSE 'Other' END AS activity_group,
  activity <> 'signup' AS enabled FROM src)"""


def _relabeled(label):
    base = USER_LOG.replace("log AS", "src AS", 1)
    return f"""{base}, {_ENTRIES}, log AS (SELECT src.* REPLACE ({label} AS activity) FROM src
  LEFT JOIN entries m ON m.enabled AND m.source_activity = src.activity)"""


_KEEP = _relabeled("coalesce(m.business_activity, src.activity)")
_GROUP = _relabeled("coalesce(m.business_activity, '__UNMAPPED__')")
_EXCLUDE = _relabeled("m.business_activity").replace("LEFT JOIN entries", "JOIN entries")
_ROLLUP = _relabeled("coalesce(m.activity_group, src.activity)")

for _key, _sql, _unmapped in (
    ("J01_business_keep_source", _KEEP, UnmappedPolicy.KEEP_SOURCE),
    ("J01_business_group_unmapped", _GROUP, UnmappedPolicy.GROUP_AS_UNMAPPED),
    ("J01_business_exclude", _EXCLUDE, UnmappedPolicy.EXCLUDE),
):

    def _business_dfg(spark, d, unmapped=_unmapped):
        return dfg_edges(mapping.business_log(user_log(spark, d), entries(spark, d), unmapped))

    query(_key, f"WITH {_sql}, {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges")(_business_dfg)


@query("J07_activity_group_dfg", f"WITH {_ROLLUP}, {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg_edges(mapping.grouped_log(user_log(spark, d), entries(spark, d)))


@query("F03_replaced_activity", f"WITH {_GROUP} SELECT event_id, case_id, activity, org_code, duration_ms FROM log")
def _(spark, d):
    log = mapping.business_log(user_log(spark, d), entries(spark, d), UnmappedPolicy.GROUP_AS_UNMAPPED)
    return log.select("event_id", "case_id", "activity", "org_code", "duration_ms")


@query("F04_excluded_events", f"WITH {_EXCLUDE} SELECT event_id, case_id, activity FROM log")
def _(spark, d):
    log = mapping.business_log(user_log(spark, d), entries(spark, d), UnmappedPolicy.EXCLUDE)
    return log.select("event_id", "case_id", "activity")


_COVERAGE = f"""WITH {USER_LOG.replace('log AS', 'src AS', 1)}, {_ENTRIES}, cover AS (
  SELECT src.activity AS source_activity, any_value(m.business_activity) AS business_activity, count(*) AS event_count,
         count(DISTINCT case_id) AS case_count, count(m.source_activity) > 0 AS mapped
  FROM src LEFT JOIN entries m ON m.enabled AND m.source_activity = src.activity GROUP BY 1)"""


def _coverage(spark, d):
    return mapping.coverage_rows(user_log(spark, d), entries(spark, d))


@query("J02_mapping_coverage", f"{_COVERAGE} FROM cover")
def _(spark, d):
    return _coverage(spark, d)


@query("L07_coverage_order", f"{_COVERAGE} FROM cover ORDER BY event_count DESC, source_activity LIMIT 3")
def _(spark, d):
    return _coverage(spark, d).limit(3)


@query("F06_coverage_search", f"{_COVERAGE} FROM cover WHERE mapped AND (source_activity ILIKE '%R%' OR business_activity ILIKE '%R%')")
def _(spark, d):
    return mapping.filter_coverage(_coverage(spark, d), "mapped", " R ")


for _policy, _business in (("KEEP_SOURCE", 4), ("GROUP_AS_UNMAPPED", 4), ("EXCLUDE", 3)):

    def _summary(spark, d, policy=_policy):
        return mapping.coverage_summary(_coverage(spark, d), UnmappedPolicy(policy))

    _label = {
        "KEEP_SOURCE": "coalesce(business_activity, source_activity)",
        "GROUP_AS_UNMAPPED": "coalesce(business_activity, '__UNMAPPED__')",
        "EXCLUDE": "business_activity",
    }[_policy]
    query(
        f"A15_coverage_{_policy.lower()}",
        f"""{_COVERAGE} SELECT count(*) AS unique_source_activities, count_if(mapped) AS mapped_activities,
  count_if(NOT mapped) AS unmapped_activities, count(DISTINCT {_label}) AS business_activities,
  CAST(sum(event_count) FILTER (WHERE mapped) AS BIGINT) AS mapped_event_count,
  CAST(sum(event_count) FILTER (WHERE NOT mapped) AS BIGINT) AS unmapped_event_count,
  round(count_if(mapped) / CAST(count(*) AS DOUBLE), 6) AS activity_mapping_coverage,
  round(CAST(sum(event_count) FILTER (WHERE mapped) AS DOUBLE) / CAST(sum(event_count) AS DOUBLE), 6) AS event_mapping_coverage
FROM cover""",
    )(_summary)


@query(
    "V06_mapping_comparison",
    f"""WITH {USER_LOG.replace('log AS', 'src AS', 1)}, {_ENTRIES}
SELECT source_activity, CASE WHEN enabled THEN business_activity END AS old_label,
  CASE WHEN source_activity <> 'view' THEN CASE WHEN source_activity = 'error' THEN 'Failure' ELSE business_activity END END AS new_label,
  CASE WHEN NOT enabled THEN 'ADDED' WHEN source_activity = 'view' THEN 'REMOVED' WHEN source_activity = 'error' THEN 'CHANGED'
       ELSE 'UNCHANGED' END AS change
FROM entries""",
)
def _(spark, d):
    old = entries(spark, d)
    label = F.when(F.col("source_activity") == "error", "Failure").otherwise(F.col("business_activity"))
    padded = {"source_activity": F.concat(F.lit(" "), "source_activity"), "business_activity": F.concat(label, F.lit(" "))}
    new = old.withColumns(padded | {"enabled": F.col("source_activity") != "view"})
    return mapping.compare_mapping_sets(old, new)


@query(
    "V07_repeated_source_activity",
    "SELECT trim(o_orderpriority) AS source_activity, count(*) AS entry_count FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    padded = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return mapping.repeated_source_activities(orders.select(padded.alias("source_activity")))


# --- rules -------------------------------------------------------------------------------------


def _technical(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_ts"),
        F.when(F.col("user_id") % 2 == 0, "web").otherwise("app").alias("source_system"),
        F.concat(F.lit("com.shop."), F.initcap("event_type"), F.lit("Service")).alias("source_class"),
        F.concat(F.lit("do"), F.initcap("event_type")).alias("source_method"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.lit("front")).alias("module"),
    )


def _rules(spark, d):
    """Rules built from the method names that occur; priorities and windows are deterministic."""
    methods = _technical(spark, d).select("source_method").distinct()
    none, ts = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    exact = methods.select(
        F.concat(F.lit("exact-"), "source_method").alias("mapping_id"), F.lit(100).alias("priority"),
        none.alias("source_system"), none.alias("class_pattern"),
        F.concat(F.lit("^"), "source_method", F.lit("$")).alias("method_pattern"), none.alias("module_pattern"),
        F.substring("source_method", 3, 50).alias("activity_name"), F.lit("Base").alias("activity_group"),
        ts.alias("valid_from"), moment(datetime(2024, 1, 20)).alias("valid_to"),
        (F.col("source_method") != "doError").alias("enabled"),
    )
    pairs = (
        ("early-web", 200, "web", "Click|View", "front", "Browse", "2024-01-05", None),
        ("tie", 200, None, "ViewService$", "front", "Look", "2024-01-10", "2024-01-15"),
    )
    wide = [
        methods.agg(F.count("*").alias("n")).select(
            F.lit(i).alias("mapping_id"), F.lit(p).alias("priority"), F.lit(s).cast("string").alias("source_system"),
            F.lit(c).alias("class_pattern"), none.alias("method_pattern"), F.lit(m).alias("module_pattern"),
            F.lit(a).alias("activity_name"), F.lit("Special").alias("activity_group"),
            F.lit(f).cast("timestamp_ntz").alias("valid_from"), F.lit(t).cast("timestamp_ntz").alias("valid_to"),
            F.lit(True).alias("enabled"),
        )
        for i, p, s, c, m, a, f, t in pairs
    ]
    return exact.unionByName(wide[0]).unionByName(wide[1])


@query(
    "N21_priority_rules",
    """WITH src AS (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, event_type, user_id % 2 = 0 AS web FROM events),
hits AS (
  SELECT event_id, 'early-web' AS mapping_id, 'Browse' AS activity, 'Special' AS activity_group, 200 AS priority FROM src
   WHERE web AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05'
  UNION ALL SELECT event_id, 'tie', 'Look', 'Special', 200 FROM src
   WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'
  UNION ALL SELECT event_id, 'exact-do' || upper(event_type[1]) || event_type[2:],
    upper(event_type[1]) || event_type[2:], 'Base', 100 FROM src
   WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20'),
best AS (SELECT event_id, max(priority) AS priority FROM hits GROUP BY 1),
won AS (SELECT event_id, count(*) AS n, any_value(mapping_id) AS mapping_id, any_value(activity) AS activity,
        any_value(activity_group) AS activity_group FROM hits JOIN best USING (event_id, priority) GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 THEN activity END AS activity, CASE WHEN n = 1 THEN activity_group END AS activity_group,
  CASE WHEN n = 1 THEN mapping_id END AS mapping_id,
  CASE WHEN n IS NULL THEN 'UNMAPPED' WHEN n = 1 THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS mapping_status
FROM src LEFT JOIN won USING (event_id)""",
)
def _(spark, d):
    mapped = mapping.apply_activity_rules(_technical(spark, d), _rules(spark, d))
    return mapped.select("event_id", "activity", "activity_group", "mapping_id", "mapping_status")


CASE_RULES = (
    caserules.CaseRule("json", "json_path", ("props",), priority=300, path="$.k", valid_to=datetime(2024, 1, 10)),
    caserules.CaseRule("composite", "composite", ("user_id", "event_type"), priority=200, hash_required=False,
                       valid_to=datetime(2024, 1, 20)),
    caserules.CaseRule("session", "correlation", ("session",), priority=150, hash_required=False),
    caserules.CaseRule("fallback", "column", ("user_id",), priority=1, hash_required=False),
)


@query(
    "N20_case_rules",
    f"""WITH src AS (SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 3 = 0 THEN 's' || CAST(user_id AS VARCHAR) ELSE ' ' END AS session FROM events)
SELECT event_id,
  CASE WHEN ts < TIMESTAMP '2024-01-10' AND k IS NOT NULL THEN {_hmac_sql('k')}
       WHEN ts < TIMESTAMP '2024-01-20' THEN CAST(user_id AS VARCHAR) || '-' || event_type
       WHEN trim(session) <> '' THEN session ELSE CAST(user_id AS VARCHAR) END AS case_id,
  CASE WHEN ts < TIMESTAMP '2024-01-10' AND k IS NOT NULL THEN 'json' WHEN ts < TIMESTAMP '2024-01-20' THEN 'composite'
       WHEN trim(session) <> '' THEN 'session' ELSE 'fallback' END AS case_rule_id
FROM src""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn(
        "session",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).otherwise(F.lit(" ")),
    )
    cased = caserules.extract_case_id(e.withColumn("event_ts", F.col("ts")), CASE_RULES, KEY)
    return cased.select("event_id", "case_id", "case_rule_id")


@query(
    "N22_provisional_duplicates",
    """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN 'erp:' || CAST(o_custkey AS VARCHAR)
       ELSE sha256(concat_ws('|', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, o_orderstatus, '<null>')) END AS provisional_key,
  count(*) AS row_count FROM orders GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    raw_id = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string"))
    fields = [F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(None)]
    keyed = o.withColumn("provisional_key", caserules.provisional_key(F.lit("erp"), raw_id, fields))
    return caserules.provisional_duplicates(keyed)


@query("N23_attribute_whitelist", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS item FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    return caserules.whitelist_attributes(e, "props", {"item": "$.k"})


_ACTOR_PADS = privacy.hmac_pads(privacy.namespaced_key(KEY, "actor"))


@query(
    "N24_actor_token_and_ip",
    f"""SELECT event_id, {_hmac_sql("CAST(user_id AS VARCHAR)", *_ACTOR_PADS)} AS actor_hash,
  '10.' || CAST(user_id % 200 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) || '.0' AS network FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    ip = F.concat_ws(".", F.lit("10"), F.col("user_id") % 200, F.col("event_id") % 250, F.col("user_id") % 99)
    return e.select(
        "event_id",
        privacy.actor_token(F.col("user_id").cast("string"), KEY).alias("actor_hash"),
        privacy.ip_prefix(ip).alias("network"),
    )


@query(
    "N24_ipv6_network",
    """SELECT event_id, '2001:db8:' || format('{:x}', user_id % 4096) || '::/48' AS network,
  '10.' || CAST(user_id % 200 AS VARCHAR) || '.7.0' AS mapped_network FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    site = F.lpad(F.lower(F.hex(F.col("user_id") % 4096)), 4, "0")
    ip = F.concat(F.lit("2001:0DB8:"), site, F.lit("::"), F.lower(F.hex(F.col("event_id") % 65536)), F.lit("%eth0"))
    mapped = F.concat(F.lit("::FFFF:10."), F.col("user_id") % 200, F.lit(".7."), F.col("event_id") % 250)
    return e.select("event_id", privacy.ip_prefix(ip).alias("network"), privacy.ip_prefix(mapped).alias("mapped_network"))


# --- registries --------------------------------------------------------------------------------


def _registry(spark, d):
    """Orders as versions of a customer's settings: the order number only ever grows."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("mapping_id"), F.col("o_orderdate").alias("created_at"),
    )


@query(
    "V01_next_version",
    """SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, coalesce(max(o_orderkey), 0) + 1 AS next_version
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def _(spark, d):
    datasets = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    return versions.next_versions(datasets, _registry(spark, d))


@query(
    "V02_version_status",
    """SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS version, o_orderpriority AS mapping_id,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status
FROM orders""",
)
def _(spark, d):
    return versions.with_status(_registry(spark, d)).drop("created_at")


@query(
    "V03_latest_version",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS version, o_orderpriority AS mapping_id,
  {ts_text('o_orderdate')} AS created_at FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def _(spark, d):
    return versions.latest(_registry(spark, d))


def _artifacts(spark, d):
    """Order lines as artifacts: type by return flag, size by price, pinned by discount."""
    li = table(spark, d, "lineitem")
    kind = (
        F.when(F.col("l_returnflag") == "A", "NORMALIZED")
        .when(F.col("l_returnflag") == "R", "QUARANTINE")
        .when(F.col("l_linestatus") == "O", "SOURCE")
        .otherwise("TEMPORARY")
    )
    raw = li.select(
        F.col("l_orderkey").cast("string").alias("dataset_id"),
        kind.alias("artifact_type"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("bigint").alias("version"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size_bytes"),
        (F.col("l_discount") > 0.07).alias("pinned"),
    )
    return versions.active_artifacts(raw)


_ARTIFACTS = """raw AS (SELECT CAST(l_orderkey AS VARCHAR) AS dataset_id,
    CASE WHEN l_returnflag = 'A' THEN 'NORMALIZED' WHEN l_returnflag = 'R' THEN 'QUARANTINE'
         WHEN l_linestatus = 'O' THEN 'SOURCE' ELSE 'TEMPORARY' END AS artifact_type,
    CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS version,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_discount > 0.07 AS pinned FROM lineitem),
artifacts AS (SELECT *, version = max(version) OVER (PARTITION BY dataset_id, artifact_type) AS active FROM raw)"""


@query("V04_active_artifacts", f"WITH {_ARTIFACTS} SELECT dataset_id, artifact_type, version, active FROM artifacts")
def _(spark, d):
    return _artifacts(spark, d).select("dataset_id", "artifact_type", "version", "active")


@query(
    "V04_removable_artifacts",
    f"WITH {_ARTIFACTS} SELECT dataset_id, artifact_type, version FROM artifacts WHERE artifact_type <> 'SOURCE' AND NOT active AND NOT pinned",
)
def _(spark, d):
    return versions.removable_artifacts(_artifacts(spark, d)).select("dataset_id", "artifact_type", "version")


def _size(cond):
    return f"CAST(coalesce(sum(size_bytes) FILTER (WHERE {cond}), 0) AS BIGINT)"


@query(
    "A16_storage_usage",
    f"""WITH {_ARTIFACTS} SELECT dataset_id, {_size("artifact_type = 'SOURCE'")} AS raw_source,
  {_size("artifact_type = 'NORMALIZED' AND active")} AS normalized, {_size("artifact_type = 'QUARANTINE' AND active")} AS quarantine,
  {_size("artifact_type IN ('NORMALIZED', 'QUARANTINE') AND NOT active")} AS previous_versions,
  {_size("artifact_type = 'TEMPORARY'")} AS temporary, CAST(sum(size_bytes) AS BIGINT) AS total FROM artifacts GROUP BY 1""",
)
def _(spark, d):
    return versions.storage_usage(_artifacts(spark, d))


@query(
    "V08_batch_ledger",
    f"""WITH {CHECKED} SELECT 'dirty-events' AS ingestion_batch_id, 'events' AS source_system, count(*) AS raw_row_count,
  count_if(ok) AS curated_row_count, count_if(NOT ok) AS rejected_row_count, 'mapping-v3' AS mapping_version,
  'case-column-v3' AS case_rule_version, 'COMPLETED' AS status FROM checked""",
)
def _(spark, d):
    log = _normalized(spark, d)
    v = BINDING.version
    return versions.batch_ledger(log.events, log.quarantine, DATASET, "events", f"mapping-v{v}", f"case-column-v{v}")


_LEDGER = f"""WITH {USER_LOG},
keyed AS (
  SELECT *, CASE WHEN event_ts < TIMESTAMP '2024-01-11' THEN 'early' WHEN event_ts < TIMESTAMP '2024-01-21' THEN 'middle' ELSE 'late' END
    AS batch, concat_ws('|', case_id, activity, CAST(hour(event_ts) AS VARCHAR)) AS k FROM log),
counted AS (SELECT batch, k, count(*) AS n FROM keyed GROUP BY ALL),
sides AS (
  SELECT c.*, coalesce(e.n, 0) AS in_early, CASE WHEN c.batch = 'late' THEN coalesce(m.n, 0) ELSE 0 END AS in_middle
  FROM counted c LEFT JOIN counted e ON e.k = c.k AND e.batch = 'early' AND c.batch <> 'early'
  LEFT JOIN counted m ON m.k = c.k AND m.batch = 'middle' AND c.batch <> 'middle')"""


def _ledger(spark, d):
    """The user log in three batches, and a ledger of all but the last."""
    log, root = user_log(spark, d), staged_path(spark, "ledger")
    keys = [F.col("case_id"), F.col("activity"), F.hour("event_ts")]
    cuts = [None, datetime(2024, 1, 11), datetime(2024, 1, 21), None]
    parts = {name: in_range(log, *cuts[k : k + 2]) for k, name in enumerate(("early", "middle", "late"))}
    for name in ("early", "middle"):
        ledger.add_batch(spark, root, name, parts[name], keys, parts=16, filter_bits=1 << 16)
    return root, keys, parts


@query(
    "N09_duplicates_across_batches",
    f"""{_LEDGER} SELECT event_id, n AS rows_in_batch, CAST(in_early + in_middle AS BIGINT) AS earlier_rows,
  CASE WHEN in_early > 0 THEN 'early' WHEN in_middle > 0 THEN 'middle' END AS first_batch_id,
  n > 1 OR in_early + in_middle > 0 AS duplicate
FROM keyed JOIN sides USING (batch, k) WHERE batch = 'late'""",
)
def _(spark, d):
    root, keys, parts = _ledger(spark, d)
    return ledger.flag_batch(spark, root, parts["late"], keys).select(
        "event_id", "rows_in_batch", "earlier_rows", "first_batch_id", "duplicate"
    )


@query(
    "V08_ledger_batches",
    f"""{_LEDGER} SELECT batch AS batch_id, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_count,
  count_if(in_early + in_middle > 0) AS known_keys,
  CAST(coalesce(sum(n) FILTER (in_early + in_middle > 0), 0) AS BIGINT) AS known_rows FROM sides GROUP BY 1""",
)
def _(spark, d):
    root, keys, parts = _ledger(spark, d)
    ledger.add_batch(spark, root, "late", parts["late"], keys)
    return ledger.batches(spark, root).select("batch_id", "row_count", "key_count", "known_keys", "known_rows")


# --- comparison --------------------------------------------------------------------------------

MID = datetime(2024, 1, 16)


def _halves(spark, d):
    log = day_log(spark, d)
    return in_range(log, None, MID), in_range(log, MID, None)


def _half(day_log_sql, name, condition):
    """The day log restricted to one side, under its own name."""
    return f"""{name} AS (SELECT * FROM ({day_log_sql.split('AS (', 1)[1][:-1]}) WHERE {condition})"""


_A = _half(DAY_LOG, "a", "event_ts < TIMESTAMP '2024-01-16'")
_B = _half(DAY_LOG, "b", "event_ts >= TIMESTAMP '2024-01-16'")


def _facts(side):
    cases = CASES.replace("cases AS", f"cases_{side} AS", 1).replace("FROM log", f"FROM {side}")
    return f"""{cases}, facts_{side} AS (SELECT CAST(count(*) AS DOUBLE) AS case_count, CAST(sum(n) AS DOUBLE) AS event_count,
  (SELECT CAST(count(DISTINCT activity) AS DOUBLE) FROM {side}) AS activity_count,
  quantile_cont(took, 0.5) AS median_throughput_ms, quantile_cont(took, 0.9) AS p90_throughput_ms,
  count_if(n > kinds) / CAST(count(*) AS DOUBLE) AS rework_rate FROM cases_{side})"""


@query(
    "M13_compare_overview",
    f"WITH {_A}, {_B}, {_facts('a')}, {_facts('b')} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric_name, round((SELECT {m} FROM facts_a), 6) AS value_a, round((SELECT {m} FROM facts_b), 6) AS value_b,"
        f" round((SELECT {m} FROM facts_b) - (SELECT {m} FROM facts_a), 6) AS delta"
        for m in ("case_count", "event_count", "activity_count", "median_throughput_ms", "p90_throughput_ms", "rework_rate")
    ),
)
def _(spark, d):
    return compare.compare_overview(*_halves(spark, d))


def _delta_sql(keys, measures, left, right):
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys)
    cols = ", ".join(f"coalesce(x.{k}, y.{k}) AS {k}" for k in keys)
    for m in measures:
        nd = 3 if m.endswith("_ms") else 6
        v = [f"coalesce(x.{m}, 0)", f"coalesce(y.{m}, 0)"]
        wrap = (lambda t, nd=nd: f"round({t}, 6)") if m.endswith(("_ms", "_share")) else (lambda t: t)
        cols += f", {wrap(v[0])} AS {m}_a, {wrap(v[1])} AS {m}_b, {wrap(f'{v[1]} - {v[0]}')} AS {m}_delta"
    return f"SELECT {cols} FROM {left} x FULL JOIN {right} y ON {on}"


def _nodes_sql(side):
    return f"""(SELECT activity, count(*) AS event_count, count(DISTINCT case_id) AS case_count,
  count(DISTINCT case_id) / (SELECT CAST(count(DISTINCT case_id) AS DOUBLE) FROM {side}) AS case_share FROM {side} GROUP BY 1)"""


@query(
    "M13_compare_activities",
    f"WITH {_A}, {_B} " + _delta_sql(["activity"], ["event_count", "case_count", "case_share"], _nodes_sql("a"), _nodes_sql("b")),
)
def _(spark, d):
    return compare.compare_activities(*_halves(spark, d))


def _edges_of(side):
    steps = STEPS.replace("steps AS", f"steps_{side} AS", 1).replace("FROM log", f"FROM {side}")
    edges = EDGES.replace("edges AS", f"edges_{side} AS", 1).replace("FROM steps", f"FROM steps_{side}").replace("FROM log", f"FROM {side}")
    return f"{steps}, {edges}"


@query(
    "J06_compare_edges",
    f"WITH {_A}, {_B}, {_edges_of('a')}, {_edges_of('b')} "
    + _delta_sql(["source", "target"], ["transition_count", "case_count", "median_transition_ms"], "edges_a", "edges_b"),
)
def _(spark, d):
    return compare.compare_edges(*_halves(spark, d))


def _variants_sql(side):
    traces = TRACES.replace("FROM log", f"FROM {side}").split("AS (", 1)[1][:-1]
    return f"""(SELECT variant_hash, count(*) AS case_count,
  count(*) / (SELECT CAST(count(DISTINCT case_id) AS DOUBLE) FROM {side}) AS case_share FROM ({traces}) GROUP BY 1)"""


@query(
    "M13_compare_variants",
    f"WITH {_A}, {_B} " + _delta_sql(["variant_hash"], ["case_count", "case_share"], _variants_sql("a"), _variants_sql("b")),
)
def _(spark, d):
    return compare.compare_variants(*_halves(spark, d))


_TREND = f"""WITH {DAY_LOG}, {CASES} SELECT {{period}} AS period, count(*) AS case_count,
  CAST(sum(n) AS BIGINT) AS event_count, round(avg(took), 3) AS avg_throughput_ms,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms
FROM cases GROUP BY 1"""


@query("M14_daily_trend", _TREND.format(period=ts_text("date_trunc('day', first_ts)")))
def _(spark, d):
    return compare.case_trend(day_log(spark, d), "day")


@query("M14_hourly_trend", _TREND.format(period=ts_text("date_trunc('hour', first_ts)")))
def _(spark, d):
    return compare.case_trend(day_log(spark, d), "hour")


@query(
    "M15_duration_distribution",
    f"""WITH {USER_LOG}, {STEPS}, spans AS (SELECT date_diff('millisecond', event_ts, next_ts) AS ms FROM steps WHERE target IS NOT NULL)
SELECT CAST(CASE WHEN ms < 0 THEN 0 WHEN ms >= 100000000 THEN 21 ELSE floor(ms / 5000000.0) + 1 END AS BIGINT) AS bucket,
  count(*) AS transition_count FROM spans GROUP BY 1""",
)
def _(spark, d):
    return compare.duration_histogram(user_log(spark, d), 0, 100_000_000, 20)


_LABELS = ["click", "error", "purchase"]


@query(
    "M15_heatmap",
    f"WITH {USER_LOG}, {STEPS} SELECT activity AS source, "
    + ", ".join(f"count_if(target = '{t}') AS {t}" for t in _LABELS)
    + f" FROM steps WHERE activity IN ('click', 'error', 'purchase') GROUP BY 1",
)
def _(spark, d):
    return compare.edge_heatmap(user_log(spark, d), _LABELS)


# --- conformance -------------------------------------------------------------------------------


def _allowed(spark, d):
    """Reference model: edges between different activities that begin in the first half of the alphabet."""
    names = user_log(spark, d).select("activity").distinct()
    early = names.filter(F.col("activity") < "p").select(F.col("activity").alias("source"))
    targets = names.agg(F.collect_list("activity").alias("t")).scalar()
    return early.select("source", F.explode(targets).alias("target")).filter(F.col("source") != F.col("target"))


_OK = "coalesce(activity < 'p' AND activity <> target, false)"


@query(
    "M22_conformance_edges",
    f"""WITH {USER_LOG}, {STEPS} SELECT activity AS source, target, count(*) AS transition_count,
  count(DISTINCT case_id) AS case_count, {_OK} AS allowed FROM steps WHERE target IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return compare.conformance_edges(user_log(spark, d), _allowed(spark, d))


@query(
    "M22_conformance_summary",
    f"""WITH {USER_LOG}, {STEPS} SELECT count(*) AS transition_count, count_if({_OK}) AS allowed_count,
  count(DISTINCT (activity, target)) FILTER (WHERE NOT {_OK}) AS deviating_edges,
  round(count_if({_OK}) / CAST(count(*) AS DOUBLE), 6) AS fitness FROM steps WHERE target IS NOT NULL""",
)
def _(spark, d):
    return compare.conformance_summary(compare.conformance_edges(user_log(spark, d), _allowed(spark, d)))


@query(
    "M22_case_fitness",
    f"""WITH {DAY_LOG}, {STEPS} SELECT case_id, count(target) AS transition_count,
  count_if(target IS NOT NULL AND {_OK}) AS allowed_count,
  round(CASE WHEN count(target) = 0 THEN 1.0 ELSE count_if(target IS NOT NULL AND {_OK}) / CAST(count(target) AS DOUBLE) END, 6) AS fitness
FROM steps GROUP BY 1""",
)
def _(spark, d):
    return compare.case_fitness(day_log(spark, d), _allowed(spark, d))


# --- stored aggregates -------------------------------------------------------------------------

SPEC = EventFilter(date_to=JAN_20)
SIGNATURE = filter_signature(SPEC, "events")
_UNTIL = "event_ts < TIMESTAMP '2024-01-20'"
_SIGNED_LOG = f"all_{USER_LOG}, log AS (SELECT * FROM all_log WHERE {_UNTIL})"
_SIGNED_DAYS = f"all_{DAY_LOG}, log AS (SELECT * FROM all_log WHERE {_UNTIL})"


@query(
    "M20_activity_aggregate",
    f"""WITH {_SIGNED_LOG}, per AS (SELECT activity, case_id, count(*) AS n FROM log GROUP BY ALL)
SELECT activity, count(*) AS event_count, count(DISTINCT case_id) AS case_count,
  (SELECT count_if(n >= 2) FROM per WHERE per.activity = log.activity) AS rework_case_count,
  round(quantile_cont(duration_ms, 0.5), 3) AS median_duration_ms, round(quantile_cont(duration_ms, 0.9), 3) AS p90_duration_ms,
  '{SIGNATURE}' AS filter_signature FROM log GROUP BY activity""",
)
def _(spark, d):
    return compare.activity_aggregate(in_range(user_log(spark, d), None, JAN_20), SIGNATURE)


@query(
    "M20_edge_aggregate",
    f"""WITH {_SIGNED_LOG}, {STEPS}, {EDGES} SELECT '{SIGNATURE}' AS filter_signature, source AS from_activity, target AS to_activity,
  transition_count, case_count, round(median_transition_ms, 3) AS median_wait_ms, round(p90_transition_ms, 3) AS p90_wait_ms FROM edges""",
)
def _(spark, d):
    return compare.edge_aggregate(in_range(user_log(spark, d), None, JAN_20), SIGNATURE)


@query(
    "M20_variant_aggregate",
    f"""WITH {_SIGNED_DAYS}, {TRACES}, outcome AS (SELECT case_id, bool_or(result_code = 'FAILED') AS failed FROM log GROUP BY 1)
SELECT variant_hash, count(*) AS case_count, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM traces), 6) AS case_share,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms,
  round(avg(CAST(rework AS INT)), 6) AS rework_rate, round(avg(CAST(failed AS INT)), 6) AS failure_rate,
  '{SIGNATURE}' AS filter_signature FROM traces JOIN outcome USING (case_id) GROUP BY 1""",
)
def _(spark, d):
    log = in_range(day_log(spark, d), None, JAN_20)
    return compare.variant_aggregate(log, SIGNATURE, is_failed()).drop("representative_case_id", "avg_event_count")


@query(
    "M20_case_aggregate",
    f"""WITH {_SIGNED_LOG}, {CASES} SELECT case_id, {ts_text('first_ts')} AS case_start_ts, {ts_text('last_ts')} AS case_end_ts,
  took AS throughput_ms, n AS event_count, kinds AS distinct_activity_count, n > kinds AS has_rework,
  '{SIGNATURE}' AS filter_signature FROM cases""",
)
def _(spark, d):
    return compare.case_aggregate(in_range(user_log(spark, d), None, JAN_20), SIGNATURE)


@query(
    "M20_daily_aggregate",
    f"""WITH {_SIGNED_DAYS}, {CASES} SELECT {ts_text("date_trunc('day', first_ts)")} AS period, count(*) AS case_count,
  CAST(sum(n) AS BIGINT) AS event_count, round(avg(took), 3) AS avg_throughput_ms,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms,
  '{SIGNATURE}' AS filter_signature FROM cases GROUP BY 1""",
)
def _(spark, d):
    return compare.daily_aggregate(in_range(day_log(spark, d), None, JAN_20), SIGNATURE)


_MERGED = {
    "M20_activity_aggregate": (user_log, layers.activity_report, layers.ACTIVITY_KINDS),
    "M20_edge_aggregate": (user_log, layers.edge_report, layers.EDGE_KINDS),
    "M20_daily_aggregate": (day_log, layers.daily_report, layers.DAILY_KINDS),
}

for _key, (_log, _report, _kinds) in _MERGED.items():

    def _merged(spark, d, log=_log, report=_report, kinds=_kinds):
        # Batches by event, so that cases meet late events; the last batch comes first, and one comes twice.
        events = stage(in_range(log(spark, d), None, JAN_20), "layer-log")
        part = F.pmod(F.xxhash64("event_id"), F.lit(3))
        root = staged_path(spark, "layer")
        for k in (2, 0, 1, 0):
            layers.add_batch(spark, root, f"batch-{k}", events.where(part == k), buckets=8)
        return report(layers.state(spark, root, kinds), SIGNATURE)

    # Batches merged in any order give what the whole log gives: the same SQL.
    query(f"{_key}_merged", ORACLES[_key])(_merged)


@query("M21_filter_signature", f"WITH {_SIGNED_LOG} SELECT 'dataset=events;to=2024-01-20T00:00:00' AS filter_signature, count(*) AS event_count FROM log")
def _(spark, d):
    log = in_range(user_log(spark, d), None, JAN_20)
    return log.agg(F.count("*").alias("event_count")).withColumn("filter_signature", F.lit(SIGNATURE))


@query(
    "M21_signature_of_limits",
    f"""WITH {_SIGNED_LOG} SELECT count(*) AS event_count,
  'dataset=events;activity-level=business;mapping-set=v3;unmapped=EXCLUDE;to=2024-01-20T00:00:00;max_edges=5;max_nodes=9' AS filter_signature FROM log""",
)
def _(spark, d):
    signature = filter_signature(
        SPEC, "events", "business", mapping_set=3, unmapped="EXCLUDE", limits={"max_nodes": 9, "max_edges": 5}
    )
    log = in_range(user_log(spark, d), None, JAN_20)
    return log.agg(F.count("*").alias("event_count")).withColumn("filter_signature", F.lit(signature))
