"""An index of cases: which cases have an activity, an attribute value, a variant or a started day.

Cases get dense numbers. Per field and value the index keeps words of 64 cases, one bit a case; words without a bit are not
stored. A condition of terms joined by AND, OR and NOT reads the words of its terms, aligns them by place and combines them as
numbers, so no event is read before the cases are known. The log itself is laid out in slots by a hash of the case;
the events of the cases found are read from the slots these lie in.

Null values are in no word, so ``NOT`` of a term includes cases that lack the value. A value that no case has is allowed and
matches none. The index is written once for a log; a new log needs a new one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.operators.running import ranked_running_total
from loomtrail.operators.variants import case_traces
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage

WORD = 64
#: Folders the events are dealt over.
SLOTS = 256
EVERY = "_every"


@dataclass(frozen=True)
class Condition:
    """``op`` is ``term``, ``and``, ``or`` or ``not``."""

    op: str
    parts: tuple

    def __and__(self, other: Condition) -> Condition:
        return Condition("and", (self, other))

    def __or__(self, other: Condition) -> Condition:
        return Condition("or", (self, other))

    def __invert__(self) -> Condition:
        return Condition("not", (self,))

    def terms(self) -> list[tuple[str, str]]:
        found = [self.parts] if self.op == "term" else [t for p in self.parts for t in p.terms()]
        return list(dict.fromkeys(found))


def has(field: str, value: str) -> Condition:
    return Condition("term", (field, value))


def any_of(field: str, values: Sequence[str]) -> Condition:
    found = [has(field, v) for v in values]
    if not found:
        raise ValueError("name at least one value")
    whole = found[0]
    for one in found[1:]:
        whole = whole | one
    return whole


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(slots)).cast("int")


def build(
    log: DataFrame, root: str, attributes: Sequence[str] = ("result_code",), slots: int = SLOTS, policy: ScalePolicy = DEFAULT_POLICY
) -> str:
    """Write the index of a log: fields ``activity``, ``variant``, ``started`` (a day) and the given attributes."""
    ids = log.groupBy("case_id").agg(F.min("event_ts").alias("first"))
    ranked = ranked_running_total(ids.withColumn("one", F.lit(1)), [F.col("case_id").asc()], "one", policy)
    numbers = ranked.select("case_id", (F.col("rank") - 1).alias("case_no"), _slot(slots).alias("slot"), "first")
    numbers.write.parquet(f"{root}/cases")
    numbers = log.sparkSession.read.parquet(f"{root}/cases")

    def term(field: str, value: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(field).alias("field"), value.cast("string").alias("value"), "case_id").distinct()

    terms = term("activity", F.col("activity"), log)
    for name in attributes:
        terms = terms.unionByName(term(name, F.col(f"`{name}`"), log))
    terms = terms.unionByName(term("variant", F.col("variant_hash"), case_traces(log, policy=policy)))
    numbered = terms.where("value is not null").join(numbers.select("case_id", "case_no"), "case_id").drop("case_id")
    own = numbers.select(F.lit("started").alias("field"), F.date_format("first", "yyyy-MM-dd").alias("value"), "case_no")
    every = numbers.select(F.lit(EVERY).alias("field"), F.lit("").alias("value"), "case_no")
    bit = F.expr(f"shiftleft(1L, cast(case_no % {WORD} as int))")
    words = numbered.unionByName(own).unionByName(every).groupBy("field", "value", F.expr(f"case_no div {WORD}").alias("word"))
    words = words.agg(F.bit_or(bit).alias("bits"))
    by_value = words.repartitionByRange("field", "value", "word").sortWithinPartitions("field", "value", "word")
    by_value.write.partitionBy("field").parquet(f"{root}/words")
    laid = log.withColumn("slot", _slot(slots)).hint("rebalance", F.col("slot"))
    laid.write.option("compression", "zstd").partitionBy("slot").parquet(f"{root}/events")
    return root


def _combined(condition: Condition, at: dict[tuple[str, str], Column]) -> Column:
    if condition.op == "term":
        return at[condition.parts]
    parts = [_combined(p, at) for p in condition.parts]
    if condition.op == "not":
        return F.bitwise_not(parts[0])
    return parts[0].bitwiseAND(parts[1]) if condition.op == "and" else parts[0].bitwiseOR(parts[1])


def matching_words(spark: SparkSession, root: str, condition: Condition) -> DataFrame:
    """``word`` and ``bits`` of the cases that meet a condition; only words of its terms are read."""
    terms = condition.terms()
    wanted = F.lit(False)
    for field, value in [(EVERY, ""), *terms]:
        wanted = wanted | ((F.col("field") == field) & (F.col("value") == value))
    words = spark.read.schema("value string, word long, bits long, field string").parquet(f"{root}/words").where(wanted)

    def bits(field: str, value: str) -> Column:
        own = F.when((F.col("field") == field) & (F.col("value") == value), F.col("bits"))
        return F.coalesce(F.bit_or(own), F.lit(0).cast("long"))

    named = {t: f"t{k}" for k, t in enumerate(terms)}
    aligned = words.groupBy("word").agg(bits(EVERY, "").alias("every"), *[bits(*t).alias(n) for t, n in named.items()])
    met = _combined(condition, {t: F.col(n) for t, n in named.items()}).bitwiseAND(F.col("every"))
    return aligned.select("word", met.alias("bits")).where("bits <> 0")


def count_cases(spark: SparkSession, root: str, condition: Condition) -> DataFrame:
    """One row: how many cases meet a condition, without naming them."""
    found = matching_words(spark, root, condition)
    return found.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("case_count"))


def search(spark: SparkSession, root: str, condition: Condition) -> DataFrame:
    """``case_id`` and ``slot`` of the cases that meet a condition."""
    found = matching_words(spark, root, condition)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1)
    numbers = found.select("word", F.explode(places).alias("bit")).select((F.col("word") * WORD + F.col("bit")).alias("case_no"))
    return spark.read.parquet(f"{root}/cases").join(numbers, "case_no", "left_semi").select("case_id", "slot")


def events(spark: SparkSession, root: str, found: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Events of the cases that ``search`` found, read from their slots only."""
    found = stage(found.select("case_id", "slot"), "found-cases")
    # At most one number per slot of the layout.
    slots = [r["slot"] for r in found.select("slot").distinct().collect()]
    laid = spark.read.parquet(f"{root}/events").where(F.col("slot").isin(slots))
    return laid.join(broadcast_checked(found, policy), ["case_id", "slot"], "left_semi").drop("slot")
