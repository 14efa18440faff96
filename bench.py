"""Times the headline queries; prints one JSON line.

Each query runs twice to warm up and then REPEATS times; the median is reported. Results are fully
computed with Spark's no-op sink, or collected where the result is a small report.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.operators import cases, dfg, variants
from loomtrail.operators import normalize as norm
from loomtrail.plans.dirty import BINDING, CONTRACT, DATASET, KEY, raw_log
from loomtrail.plans.logs import FAILED, day_log, order_log, user_log
from loomtrail.plans.ingestion import _csv_copy
from loomtrail.scale import stage, staged_path
from loomtrail.sources import profile, readers, writers

REPEATS = 3


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomtrail-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))

    log = user_log(spark, folder)
    days = day_log(spark, folder)
    csv_path = _csv_copy(spark, folder, "events")
    raw = stage(raw_log(spark, folder).repartition(spark.sparkContext.defaultParallelism), "bench-raw")
    checked = stage(norm.validate(raw, BINDING, CONTRACT), "bench-checked")

    def report(df: DataFrame):
        return df.collect

    def full(df: DataFrame):
        return df.write.format("noop").mode("overwrite").save

    def validation():
        staged = stage(norm.validate(raw, BINDING, CONTRACT), "bench-validation")
        return norm.quality_report(staged, DATASET, BINDING.version).collect()

    failed = F.col("result_code") == FAILED
    queries = {
        "schema_inference": lambda: readers.detect_schema(spark, csv_path, "CSV").collect(),
        "profile": lambda: report(profile.profile(readers.read_csv(spark, csv_path)))(),
        "validation": validation,
        "normalized_write": lambda: writers.write_parquet(
            norm.canonical_events(checked, BINDING, CONTRACT, DATASET, KEY), staged_path(spark, "bench-events")
        ),
        "quarantine_write": lambda: writers.write_parquet(
            norm.quarantine(checked, BINDING, DATASET), staged_path(spark, "bench-quarantine")
        ),
        "dfg": lambda: dfg.directly_follows(log).fetch(),
        "dfg_edges": lambda: report(dfg.dfg_edges(log))(),
        "dfg_edges_orders": lambda: report(dfg.dfg_edges(order_log(spark, folder)))(),
        "overview": lambda: report(cases.overview(days))(),
        "variants_top": lambda: report(variants.variants_top(days))(),
        "variant_summary": lambda: full(variants.variant_summary(days, failed))(),
        "case_search": lambda: report(cases.search_cases(days, activity="signup"))(),
        "rework_by_activity": lambda: report(cases.rework_by_activity(days))(),
    }
    only = os.environ.get("BENCH_ONLY")
    seconds = {}
    for name, run in queries.items():
        if only and name not in only.split(","):
            continue
        run()
        run()
        times = []
        for _ in range(REPEATS):
            started = time.perf_counter()
            run()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "events": log.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
