"""The scalar functions the operators rest on, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.functions.quantiles import percentile_columns, split_quantiles
from loomtrail.functions.text import blank_to_null, whole_number
from loomtrail.functions.timestamps import parse_local
from loomtrail.functions.timing import millis_between, ratio
from loomtrail.operators.variants import case_sequences
from loomtrail.plans.dirty import RAW, raw_log
from loomtrail.plans.logs import LINE_LOG, ORDERED, line_log
from loomtrail.plans.registry import query, table, ts_text


@query(
    "X01_millisecond_difference",
    "SELECT event_id, date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00.0005', ts) AS elapsed_ms FROM events",
)
def _(spark, d):
    origin = F.lit("2024-01-01 00:00:00.0005").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", millis_between(origin, F.col("ts")).alias("elapsed_ms"))


_QUANTILES = {"median": 0.5, "p90": 0.9}
_X02 = """SELECT l_returnflag, round(quantile_cont(l_partkey, 0.5), 6) AS median, round(quantile_cont(l_partkey, 0.9), 6) AS p90
FROM lineitem GROUP BY 1"""


@query("X02_interpolated_quantiles", _X02)
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*percentile_columns("l_partkey", _QUANTILES))


@query("X02_interpolated_quantiles_by_bins", _X02)
def _(spark, d):
    return split_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey", _QUANTILES)


@query(
    "X03_blank_tests",
    f"WITH {RAW} SELECT source_row_number, coalesce(nullif(trim(raw_case), ''), '<none>') AS case_text FROM raw",
)
def _(spark, d):
    case = F.coalesce(blank_to_null(F.col("raw_case")), F.lit("<none>"))
    return raw_log(spark, d).select("source_row_number", case.alias("case_text"))


@query("X04_concatenation", f"WITH {RAW} SELECT source_row_number, concat_ws(':', raw_id, raw_activity, raw_ts) AS joined FROM raw")
def _(spark, d):
    return raw_log(spark, d).select("source_row_number", F.concat_ws(":", "raw_id", "raw_activity", "raw_ts").alias("joined"))


@query(
    "X05_tolerant_casts",
    f"""WITH {RAW} SELECT source_row_number, try_cast(raw_sequence AS BIGINT) AS number,
  {ts_text('try_cast(CASE WHEN length(raw_ts) = 19 THEN raw_ts END AS TIMESTAMP)')} AS moment FROM raw""",
)
def _(spark, d):
    naive = F.when(F.length("raw_ts") == 19, F.col("raw_ts"))
    return raw_log(spark, d).select(
        "source_row_number", whole_number(F.col("raw_sequence")).alias("number"), parse_local(naive).alias("moment")
    )


@query(
    "X06_formatted_parse",
    f"SELECT event_id, {ts_text('''try_strptime(strftime(ts, '%d.%m.%Y %H:%M:%S.%f'), '%d.%m.%Y %H:%M:%S.%f')''')} AS moment FROM events",
)
def _(spark, d):
    text = F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select("event_id", parse_local(text, "%d.%m.%Y %H:%M:%S.%f").alias("moment"))


@query(
    "X07_zone_conversion",
    f"""SELECT event_id, {ts_text("timezone('UTC', timezone('Europe/Berlin', ts))")} AS as_utc,
  {ts_text("timezone('Asia/Tokyo', timezone('UTC', ts))")} AS as_tokyo FROM events""",
)
def _(spark, d):
    def convert(a, b):
        return F.convert_timezone(F.lit(a), F.lit(b), F.col("ts"))

    return table(spark, d, "events").select(
        "event_id", convert("Europe/Berlin", "UTC").alias("as_utc"), convert("UTC", "Asia/Tokyo").alias("as_tokyo")
    )


@query("X08_pattern_match", "SELECT doc_id, regexp_matches(text, '(license|copyright)', 'i') AS mentions_license FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?i)(license|copyright)").alias("mentions_license"))


@query("X09_hashes", "SELECT doc_id, sha256(text) AS digest, sha256(unhex(sha256(text)) || encode(lang)) AS nested FROM documents")
def _(spark, d):
    digest = F.sha2("text", 256)
    nested = F.sha2(F.concat(F.unhex(digest), F.encode("lang", "UTF-8")), 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("digest"), nested.alias("nested"))


@query(
    "X10_ordered_text_aggregate",
    f"WITH {LINE_LOG} SELECT case_id, string_agg(activity, ' > ' ORDER BY {ORDERED}) AS variant_sequence FROM log GROUP BY 1",
)
def _(spark, d):
    return case_sequences(line_log(spark, d))


@query("X12_date_of_timestamp", "SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("event_date")).agg(F.count("*").alias("n"))


@query(
    "X13_guarded_ratio",
    "SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(l_quantity / nullif(l_linenumber - 1, 0), 0), 6) AS share FROM lineitem",
)
def _(spark, d):
    share = ratio(F.col("l_quantity"), F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", share.alias("share"))


@query("X14_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing")
    )
