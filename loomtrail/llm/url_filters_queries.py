"""Query of the URL filters, next to its SQL.

Captures are the pages, fetched at minutes spread over a year. The list is drawn from the pages' own hosts,
parent domains and first path steps: each has three entries whose days and actions follow from its
name's MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import url_filters as uf
from loomtrail.llm.registry import query, table

START = 1_767_225_600
DAYS = 365


def captures(pages: DataFrame) -> DataFrame:
    minute = F.pmod(F.col("page_id") * 7919, F.lit(DAYS * 1440))
    return pages.select("page_id", "url", (F.lit(START) + minute * 60).alias("fetched_at"))


def entries(pages: DataFrame) -> DataFrame:
    host = uf.url_host(F.col("url"))
    first = F.concat_ws("/", host, F.regexp_extract(uf.url_path(F.col("url")), "^/([^/]+)", 1))
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    names = pages.select(F.explode(F.array(host, parent, first)).alias("pattern")).where(
        "pattern <> '' AND NOT pattern LIKE '%/'"
    ).distinct()
    sums = names.withColumn("c", F.conv(F.substr(F.md5("pattern"), F.lit(1), F.lit(7)), 16, 10).cast("long"))
    rows = sums.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    step = F.floor(F.col("c") / F.pow(F.lit(7), F.col("k"))).cast("long")
    action = F.element_at(F.array(*[F.lit(a) for a in uf.ACTIONS]), (F.pmod(step, F.lit(3)) + 1).cast("int"))
    day = F.pmod(F.floor(F.col("c") / F.pow(F.lit(13), F.col("k"))).cast("long"), F.lit(DAYS))
    return rows.select("pattern", action.alias("action"), (F.lit(START) + day * 86_400).alias("listed_at"))


SQL = rf"""
WITH page AS (
  SELECT page_id, url, {START} + ((page_id * 7919) % {DAYS * 1440}) * 60 AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
name AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_extract(host, '([^.]+\.[^.]+)$', 1),
                   host || '/' || regexp_extract(path, '^/([^/]+)', 1)]) AS pattern FROM page)
  WHERE pattern <> '' AND NOT pattern LIKE '%/'),
entry AS (
  SELECT pattern, {START} + (CAST(floor(c / 13 ** k) AS BIGINT) % {DAYS}) * 86400 AS begins,
         1 + CAST(floor(c / 7 ** k) AS BIGINT) % 3 AS action
  FROM (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS c FROM name), range(3) AS r(k)),
span AS (
  SELECT pattern, begins, action, lead(begins) OVER (PARTITION BY pattern ORDER BY begins) AS ends
  FROM (SELECT pattern, begins, min(action) AS action FROM entry GROUP BY ALL)),
step AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS steps, string_split(host, '.') AS labels FROM page),
key AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[:i], '/'))))) AS pattern
  FROM step WHERE host <> ''),
best AS (
  SELECT page_id, url, count(*) AS n, arg_max(struct_pack(p := pattern, a := action, b := begins), (length(pattern), pattern)) AS rule
  FROM key JOIN span USING (pattern)
  WHERE action < 3 AND fetched_at >= begins AND (ends IS NULL OR fetched_at < ends)
  GROUP BY page_id, url)
SELECT page.page_id, page.url, fetched_at, coalesce(n, 0) AS n_active,
       coalesce(['block', 'allow'][rule.a], 'none') AS verdict, rule.p AS pattern, rule.b AS listed_at
FROM page LEFT JOIN best ON page.page_id = best.page_id AND page.url = best.url"""


@query("op10_temporal_url_lists", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    judged = uf.judge(captures(pages), entries(pages))
    return judged.withColumn("fetched_at", F.unix_timestamp("fetched_at")).withColumn(
        "listed_at", F.unix_timestamp("listed_at")
    )
