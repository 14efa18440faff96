"""Business activities: exact mapping sets, coverage and rule-based mapping.

A mapping set is a DataFrame ``source_activity, business_activity, enabled`` and optionally
``activity_group``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.text import blank_to_null
from loomtrail.functions.timing import ratio
from loomtrail.model import UNMAPPED_LABEL, UnmappedPolicy
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage


def enabled_entries(entries: DataFrame, label: str = "business_activity") -> DataFrame:
    """Entries in use, texts trimmed; a blank label is none."""
    return entries.filter("enabled").select(
        F.trim("source_activity").alias("activity"), blank_to_null(F.col(label)).alias("_label"), F.lit(True).alias("_mapped")
    )


def check_entries(entries: DataFrame) -> DataFrame:
    """Reject sets that name a source activity twice: such an entry would multiply events."""
    named = enabled_entries(entries.withColumn("_none", F.lit(None).cast("string")), "_none")
    twice = named.groupBy("activity").count().filter("count > 1").orderBy("activity").limit(5).collect()
    if twice:
        raise ValueError(f"repeated source activities: {[r['activity'] for r in twice]}")
    return entries


def business_log(
    log: DataFrame,
    entries: DataFrame,
    unmapped: UnmappedPolicy = UnmappedPolicy.KEEP_SOURCE,
    label: str = "business_activity",
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The log with activities replaced by their mapped label; other columns stay.

    Entries are trimmed, and repeated ones rejected. ``EXCLUDE`` removes events without a label, so that
    transitions bridge over them.
    """
    mapped = enabled_entries(check_entries(entries), label)
    if unmapped == UnmappedPolicy.EXCLUDE:
        mapped = mapped.filter(F.col("_label").isNotNull())
    how = "inner" if unmapped == UnmappedPolicy.EXCLUDE else "left"
    joined = log.join(broadcast_checked(mapped, policy), "activity", how)
    fallback = {
        UnmappedPolicy.KEEP_SOURCE: F.col("activity"),
        UnmappedPolicy.GROUP_AS_UNMAPPED: F.lit(UNMAPPED_LABEL),
        UnmappedPolicy.EXCLUDE: F.lit(None),
    }[unmapped]
    relabeled = joined.withColumn("activity", F.coalesce("_label", fallback))
    return relabeled.select(*log.columns)


def grouped_log(log: DataFrame, entries: DataFrame, unmapped: UnmappedPolicy = UnmappedPolicy.KEEP_SOURCE) -> DataFrame:
    """Roll-up to the coarser activity group."""
    return business_log(log, entries, unmapped, label="activity_group")


def coverage_rows(log: DataFrame, entries: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per source activity; counted first, so the join sees activities, not events. Repeated entries are rejected."""
    counts = log.groupBy("activity").agg(
        F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count")
    )
    return (
        counts.join(broadcast_checked(enabled_entries(check_entries(entries)), policy), "activity", "left")
        .select(
            F.col("activity").alias("source_activity"),
            F.col("_label").alias("business_activity"),
            "event_count",
            "case_count",
            F.col("_mapped").isNotNull().alias("mapped"),
        )
        .orderBy(F.desc("event_count"), "source_activity")
    )


def filter_coverage(rows: DataFrame, show: str = "all", search: str = "") -> DataFrame:
    """Coverage rows by mapped state and case-insensitive text in either label."""
    if show not in ("all", "mapped", "unmapped"):
        raise ValueError("show must be all, mapped or unmapped")
    if show != "all":
        rows = rows.filter(F.col("mapped") == F.lit(show == "mapped"))
    wanted = search.strip().lower()
    if wanted:
        rows = rows.filter(
            F.lower("source_activity").contains(wanted)
            | F.lower(F.coalesce("business_activity", F.lit(""))).contains(wanted)
        )
    return rows


def coverage_summary(rows: DataFrame, unmapped: UnmappedPolicy = UnmappedPolicy.KEEP_SOURCE) -> DataFrame:
    resolved = F.when(F.col("mapped"), F.col("business_activity"))
    if unmapped == UnmappedPolicy.KEEP_SOURCE:
        resolved = F.coalesce(resolved, "source_activity")
    elif unmapped == UnmappedPolicy.GROUP_AS_UNMAPPED:
        resolved = F.coalesce(resolved, F.lit(UNMAPPED_LABEL))
    n = F.count("*")
    mapped = F.count_if("mapped")
    events = F.coalesce(F.sum("event_count"), F.lit(0))
    mapped_events = F.coalesce(F.sum(F.when(F.col("mapped"), F.col("event_count"))), F.lit(0))
    return rows.agg(
        n.alias("unique_source_activities"),
        mapped.alias("mapped_activities"),
        (n - mapped).alias("unmapped_activities"),
        F.count_distinct(resolved).alias("business_activities"),
        mapped_events.alias("mapped_event_count"),
        (events - mapped_events).alias("unmapped_event_count"),
        ratio(mapped, n).alias("activity_mapping_coverage"),
        ratio(mapped_events, events).alias("event_mapping_coverage"),
    )


def repeated_source_activities(entries: DataFrame) -> DataFrame:
    """Source activities, trimmed, that occur more than once in a mapping set."""
    return (
        entries.groupBy(F.trim("source_activity").alias("source_activity"))
        .agg(F.count("*").alias("entry_count"))
        .filter(F.col("entry_count") > 1)
    )


def compare_mapping_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Which labels two versions of a mapping set give differently. Texts are trimmed; repeated entries are rejected."""
    before, after = (
        enabled_entries(check_entries(entries)).select(
            F.col("activity").alias("source_activity"), F.col("_label").alias(f"{side}_label"), F.lit(True).alias(f"_{side}")
        )
        for entries, side in ((old, "old"), (new, "new"))
    )
    change = (
        F.when(F.col("_old").isNull(), "ADDED")
        .when(F.col("_new").isNull(), "REMOVED")
        .when(F.col("old_label").eqNullSafe(F.col("new_label")), "UNCHANGED")
        .otherwise("CHANGED")
    )
    joined = before.join(after, "source_activity", "full_outer").withColumn("change", change)
    return joined.select("source_activity", "old_label", "new_label", "change")


# --- rules -------------------------------------------------------------------------------------

SIGNATURE = ("source_system", "source_class", "source_method", "module")
MAPPED, AMBIGUOUS, UNMAPPED = "MAPPED", "AMBIGUOUS", "UNMAPPED"


#: Lengths of the literal beginnings that rules are looked up by.
KEY_LENGTHS = (24, 12, 6, 3)
_KEYED = {"class_pattern": "source_class", "method_pattern": "source_method"}


def _rule_key(pattern: str) -> Column:
    """The longest beginning of ``KEY_LENGTHS`` that whatever fits the pattern starts with; NULL if there is none.

    Only patterns tied to the beginning and without alternatives have one; a letter that a quantifier makes
    optional does not count.
    """
    run = F.when(
        ~F.col(pattern).contains("|"), F.regexp_extract(pattern, r"^\^([A-Za-z0-9_]+)(?![*?{])", 1)
    )
    return F.coalesce(
        *[
            F.when(F.length(run) >= n, F.struct(F.lit(pattern).alias("of"), F.substring(run, 1, n).alias("text")))
            for n in KEY_LENGTHS
        ]
    )


def _fits(r: Column) -> Column:
    def pattern(value: str, rule: str) -> Column:
        return r[rule].isNull() | F.coalesce(F.rlike(F.col(value), r[rule]), F.lit(False))

    system = r["source_system"].isNull() | F.col("source_system").eqNullSafe(r["source_system"])
    return (
        system
        & pattern("source_class", "class_pattern")
        & pattern("source_method", "method_pattern")
        & pattern("module", "module_pattern")
    )


def _winner(rules: Column) -> Column:
    """Of rules in falling order of priority: how many share the first place, and the rule if it is one."""
    top = F.filter(rules, lambda r: r["priority"] == F.get(rules, F.lit(0))["priority"])
    one = F.when(F.size(top) == 1, F.get(rules, F.lit(0)))
    return F.struct(
        F.size(top).alias("hits"), one["activity_name"].alias("activity_name"),
        one["activity_group"].alias("activity_group"), one["mapping_id"].alias("mapping_id"),
    )


def rule_index(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Per technical name the winning rule of every elementary interval of validity, and ``undated``, that of no time.

    ``names``: rows of ``SIGNATURE``, each once. Rules whose patterns begin with literals are joined by these; the others
    are tried on each name. ``intervals`` are sorted by ``start``, the first of which is NULL: from ever.
    Names that no rule fits are left out. A name gathers the rules that fit it, at most all rules.
    """
    fields = ["mapping_id", "priority", "source_system", "class_pattern", "method_pattern", "module_pattern",
              "activity_name", "activity_group", "valid_from", "valid_to"]
    keys = F.array_compact(F.array(*[_rule_key(p) for p in _KEYED]))
    longest = F.get(F.array_sort(keys, lambda a, b: F.length(b["text"]) - F.length(a["text"])), F.lit(0))
    enabled = rules.filter(F.col("enabled") & F.col("priority").isNotNull()).select(F.struct(*fields).alias("_rule"), longest.alias("_key"))
    loose = enabled.where(F.col("_key").isNull()).agg(F.collect_list("_rule").alias("r"))
    tried = names.withColumn("_rules", loose.scalar()).select(*SIGNATURE, F.explode(F.filter("_rules", _fits)).alias("_rule"))
    beginnings = F.array(
        *[
            F.when(F.length(c) >= n, F.struct(F.lit(p).alias("of"), F.substring(c, 1, n).alias("text")))
            for p, c in _KEYED.items()
            for n in KEY_LENGTHS
        ]
    )
    begun = names.select(*SIGNATURE, F.explode(F.array_compact(beginnings)).alias("_key"))
    found = begun.join(enabled, "_key").where(_fits(F.col("_rule"))).select(*SIGNATURE, "_rule")
    falling = F.array_sort(
        F.collect_list("_rule"), lambda a, b: F.when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1).otherwise(0)
    )
    fitting = tried.unionByName(found).groupBy(*SIGNATURE).agg(falling.alias("_rules"))
    bounds = F.sort_array(F.array_distinct(F.array_compact(F.flatten(F.transform("_rules", lambda r: F.array(r["valid_from"], r["valid_to"]))))))
    never = F.array(F.lit(None).cast(rules.schema["valid_from"].dataType))

    def live(start: Column) -> Column:
        def at(r: Column) -> Column:
            begun = r["valid_from"].isNull() | F.coalesce(r["valid_from"] <= start, F.lit(False))
            return begun & (r["valid_to"].isNull() | start.isNull() | (start < r["valid_to"]))

        return F.filter("_rules", at)

    undated = F.filter("_rules", lambda r: r["valid_from"].isNull() & r["valid_to"].isNull())
    return fitting.select(
        *SIGNATURE,
        F.transform(F.concat(never, bounds), lambda b: F.struct(b.alias("start"), _winner(live(b)).alias("won"))).alias("intervals"),
        _winner(undated).alias("undated"),
    )


def apply_activity_rules(events: DataFrame, rules: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Priority rules on technical names with a validity window.

    ``rules``: ``mapping_id, priority, source_system, class_pattern, method_pattern, module_pattern,
    activity_name, activity_group, valid_from, valid_to, enabled`` (patterns are regular expressions,
    NULL matches anything). The highest priority wins; two rules at the top priority make the event
    ambiguous. An event without a time meets rules without bounds only. Patterns are tried and winners found
    once per distinct technical name (:func:`rule_index`); an event looks up the interval of its time.
    """
    names = stage(events.select(*SIGNATURE).distinct(), "rule-names")
    index = stage(rule_index(names, rules), "rule-index")
    index = index.select(*[F.col(c).alias(f"_{c}") for c in SIGNATURE], "intervals", "undated")
    index = index.withColumnsRenamed({"intervals": "_intervals", "undated": "_undated"})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SIGNATURE]
    ts = F.col("event_ts")
    # Of sorted intervals the last that has begun.
    begun = F.filter("_intervals", lambda i: i["start"].isNull() | (i["start"] <= ts))
    won = F.when(ts.isNull(), F.col("_undated")).otherwise(F.try_element_at(begun, F.lit(-1))["won"])
    hits = F.coalesce(F.col("_won.hits"), F.lit(0))
    return (
        events.join(broadcast_checked(index, policy), same, "left")
        .withColumn("_won", won)
        .select(
            *[c for c in events.columns if c != "activity"],
            F.col("_won.activity_name").alias("activity"),
            F.col("_won.activity_group").alias("activity_group"),
            F.col("_won.mapping_id").alias("mapping_id"),
            F.when(hits == 0, UNMAPPED).when(hits == 1, MAPPED).otherwise(AMBIGUOUS).alias("mapping_status"),
        )
    )
