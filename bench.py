"""Seconds per headline query, cold and warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirelens import catalog  # noqa: E402
from wirelens.session import get_spark  # noqa: E402

HEADLINE = [
    "window_features", "flow_summary", "flow_pairs", "capture_quality", "window_counts", "suite_detection",
    "sequence_health", "rekey_interval", "negotiations", "flow_negotiation_asof", "policy_findings",
    "capture_scores", "threat_matrix", "exposure", "fold_split", "label_verification", "model_evaluation",
    "calibration_error", "prediction_spans", "capture_catalogue", "decoded_frames",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.load()

    def timed(name: str) -> float:
        start = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = timed(name)
        warm[name] = timed(name)
    # The like-for-like run of the published figure; beside the headline, so that totals compare.
    extra = {name: [timed(name), timed(name)] for name in ("assessment_findings",)}
    packets = entries["packet_protocol_counts"].run(spark, folder).agg({"packets": "sum"}).first()[0]
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "extra_cold_warm": extra, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "packets": packets, "packets_per_s": round(packets / warm["window_features"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
