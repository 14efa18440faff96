"""URL filters by temporal list join: every capture meets the list entries that were active when it was fetched.

A list entry says from when on a pattern is blocked, allowed or cleared. The entries of a pattern, in
order of their dates, become validity intervals: each holds until the next one begins. A pattern is a
host with all below it (``example.com``) or a path with all below it (``example.com/de``). A capture has one
key for each level of its host and its path; it is joined with the intervals of these keys that contain
its time. The longest active pattern decides; ``clear`` makes a pattern inactive.

Intervals are also cut at bounds of ``BUCKET_DAYS``, so that the join is by key and bucket: a capture meets
the few entries of one pattern in one bucket, however long the pattern's history is.

Results on edge cases: a capture without a readable URL or without a time has no active entry; of entries
of one pattern and time, ``block`` goes before ``allow`` before ``clear``; entries without pattern, time or
action are void; equal captures all get the result; an empty list leaves all captures without an entry; an
empty table of captures gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_DAYS = 90
ACTIONS = ("block", "allow", "clear")
_DAY = 86_400


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """The host, its parent domains, and the host with each beginning of its path."""
    labels = F.split(url_host(url), r"\.")
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    paths = F.when(
        F.size(steps) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(steps)),
            lambda i: F.concat_ws("/", url_host(url), F.array_join(F.slice(steps, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(url_host(url) == "", none).otherwise(F.coalesce(F.array_distinct(F.concat(hosts, paths)), none))


def _bucket(second: Column) -> Column:
    return F.floor(second / (BUCKET_DAYS * _DAY)).cast("long")


def intervals(entries: DataFrame, horizon: int) -> DataFrame:
    """Intervals ``[begins, ends)`` in seconds, cut into buckets up to the ``horizon``."""
    listed = entries.select("pattern", "action", F.col("listed_at").cast("long").alias("begins")).where(
        F.col("pattern").isNotNull() & F.col("begins").isNotNull() & F.col("action").isin(*ACTIONS)
    )
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    one = listed.groupBy("pattern", "begins").agg(F.min_by("action", rank).alias("action"))
    ends = F.lead("begins").over(W.partitionBy("pattern").orderBy("begins"))
    spans = one.withColumn("ends", ends).where("action <> 'clear'")
    last = F.least(F.coalesce(F.col("ends") - 1, F.lit(horizon)), F.lit(horizon))
    cut = spans.where(F.col("begins") <= horizon).withColumn(
        "bucket", F.explode(F.sequence(_bucket(F.col("begins")), _bucket(last)))
    )
    return cut.select("pattern", "bucket", "action", "begins", "ends")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per row of ``captures`` (page_id, url, fetched_at): the number of active entries and the one that decides."""
    rows = captures.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("fetched_at").cast("long").alias("at")
    )
    # Equal captures are judged once.
    own = rows.groupBy("page_id", "url", "at").agg(F.count(F.lit(1)).alias("copies"))
    horizon = rows.agg(F.max("at").alias("last")).first()["last"]
    spans = intervals(entries, 0 if horizon is None else horizon)
    keyed = own.select("page_id", "url", "at", F.explode(url_keys(F.col("url"))).alias("pattern")).withColumn(
        "bucket", _bucket(F.col("at"))
    )
    active = keyed.join(spans, ["pattern", "bucket"]).where(
        (F.col("at") >= F.col("begins")) & (F.col("ends").isNull() | (F.col("at") < F.col("ends")))
    )
    longest = F.struct(F.length("pattern"), F.col("pattern"))
    best = active.groupBy("page_id", "url", "at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.max_by(F.struct("pattern", "action", "begins"), longest).alias("rule"),
    ).toDF("b_page", "b_url", "b_at", "n_active", "rule")
    same = F.col("page_id").eqNullSafe(F.col("b_page")) & (F.col("url") == F.col("b_url")) & (F.col("at") == F.col("b_at"))
    judged = own.join(best, same, "left").select("page_id", "url", "at", "copies", "n_active", "rule")
    return judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id",
        "url",
        F.timestamp_seconds("at").alias("fetched_at"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("rule.action", F.lit("none")).alias("verdict"),
        F.col("rule.pattern").alias("pattern"),
        F.timestamp_seconds("rule.begins").alias("listed_at"),
    )
