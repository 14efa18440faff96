"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's word shingles, ascending. The
sketch of a union is made of the sketches of its parts, so sketches merge; the share of common hashes
among the ``k`` smallest of two sketches together estimates their resemblance; the k-th hash estimates
how many distinct shingles there are; both together give containment.

Results on edge cases: a null text counts as empty; a text without words has an empty sketch; fewer words
than a shingle form one shingle; two empty sketches have resemblance 1, an empty and another 0; equal texts
have equal sketches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.llm.text_native import once, windows, words

K = 128
SHINGLE_WORDS = 5


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """Add the sketch of a text column that has no nulls."""
    df = once(df, _f_words=words(F.col(text)))
    few = F.when(F.size("_f_words") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("_f_words")))
    hashes = F.when(F.size("_f_words") < size, few).otherwise(windows(F.col("_f_words"), size))
    return once(df, **{name: _smallest(hashes, k)}).drop("_f_words")


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two sketches together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = union(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k``, else from the share of the hash range that the k-th hash has reached."""
    reached = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reached)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of the first one's shingles that the second one has, at most 1."""
    common = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(sketches: DataFrame, keys: list[str], name: str, k: int = K) -> DataFrame:
    """One sketch for each key, of any number of parts; only the smallest hashes of a task are shuffled."""
    hashes = sketches.select(*keys, F.explode(name).alias("h"))
    # Equal hashes of different parts: k of them could crowd out others, so they go first.
    distinct = hashes.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("parts"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("h"))
    lowest = distinct.withColumn("nth", nth).where(F.col("nth") <= k)
    return lowest.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(name))
