"""Query of the quality rules, next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import quality
from loomtrail.llm.registry import query, table

_CLOSED = r"""[.!?\x{2026}\x{061F}\x{06D4}\x{0964}\x{0965}\x{104B}\x{1362}\x{1367}\x{17D4}\x{3002}\x{FF01}\x{FF1F}]["'')\]\x{201D}\x{2019}\x{00BB}]*"""
_NAMES = r"(?i)\b(enable javascript|uses cookies|cookie policy|privacy policy|terms of use|terms of service|lorem ipsum|click here to|subscribe to our)\b"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


_LINE = rf"""regexp_matches(l, '{_CLOSED}([\x20\x09-\x0D]|$)|[\x{{0E01}}-\x{{0E5B}}][\x20\x09-\x0D]*$')
  AND coalesce(list_sum(list_transform(range(CAST(ceil(len({_words("l")}) / 64.0) AS BIGINT)), lambda k:
        CASE WHEN len({_words("l")}[k * 64 + 1 : k * 64 + 64]) >= 10
                  AND len(list_distinct({_words("l")}[k * 64 + 1 : k * 64 + 64])) * 4 <= len({_words("l")}[k * 64 + 1 : k * 64 + 64])
             THEN len({_words("l")}[k * 64 + 1 : k * 64 + 64]) ELSE 0 END)), 0) * 2 <= len({_words("l")})"""

_SENTENCE = rf"""NOT (length(s) - length(replace(s, '|', '')) >= 3
           AND (length(s) - length(replace(s, '|', ''))) * 10 >= len({_words("s")}))
  AND NOT (length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g'))) * 10 > length(s)
  AND NOT (length(s) - length(regexp_replace(s, '[A-Za-z]', '', 'g')) >= 20
           AND (length(s) - length(regexp_replace(s, '[A-Z]', '', 'g'))) * 2
               > length(s) - length(regexp_replace(s, '[A-Za-z]', '', 'g')))
  AND NOT (regexp_matches(s, '{_NAMES}')
           AND len(regexp_extract_all(s, '{_NAMES}')) * 40 >= len({_words("s")}))"""

SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
word_at AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM cut),
win AS (
  SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM word_at),
twice AS (SELECT r, i, n = 8 AND count(*) OVER (PARTITION BY r, g, n) > 1 AS t2 FROM win),
rep AS (
  SELECT r, count_if(c) AS n FROM (
    SELECT r, bool_or(t2) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice)
  GROUP BY r),
line AS (SELECT r, unnest(lines) AS l, unnest(range(len(lines))) AS i FROM cut),
first AS (SELECT r, l, min(i) AS i FROM line WHERE {_LINE} GROUP BY r, l),
whole AS (
  SELECT r, i, array_to_string(list_filter(
           string_split(regexp_replace(l, '({_CLOSED}[\x20\x09-\x0D]+)', '\1' || chr(10), 'g'), chr(10)),
           lambda s: {_SENTENCE}), '') AS l
  FROM first),
good AS (SELECT r, i, l FROM whole WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
clean AS (SELECT r, string_agg(l, chr(10) ORDER BY i) AS t, count(*) AS n FROM good GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(cut.t) - length(regexp_replace(cut.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - coalesce(clean.n, 0) AS BIGINT) AS n_removed_lines,
         CAST(len(list_filter(regexp_split_to_array(coalesce(clean.t, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS words_left,
         CAST(length(coalesce(clean.t, '')) AS BIGINT) AS clean_chars
  FROM cut LEFT JOIN rep USING (r) LEFT JOIN clean USING (r))
SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
       NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND words_left * 2 >= n_words AS kept
FROM m"""


@query("op7_line_first_quality", SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.measure(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return judged.withColumn("clean_chars", F.length("clean_text").cast("long")).drop("clean_text")
