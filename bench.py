"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores. Every query is built
and run once to warm up and then BENCH_RUNS times; its time is the median, plan building included.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cargoledger.plans.queries import QUERIES

HEADLINE = [
    "cif_by_shipment",
    "e6_freight_invoice",
    "k1_aforo",
    "j1_tariff_lookup",
    "j11_translation",
    "j5_invoice_parties",
    "j6_consolidated_documents",
    "n1_item_numbers",
    "f1_normalize_text",
    "f9_number_parser",
    "p1_field_validation",
    "e14_validation_report",
    "a16_document_errors",
    "e17_quality_metrics",
    "e20_processing_statistics",
    "s9_answer_parse",
    "s10_typed_items",
    "u4_file_outcomes",
    "u1_save_documents",
    "k9_service_invoice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cargoledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
