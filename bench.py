"""Time the headline queries and print one JSON line.

Every query is executed in full into a sink that discards rows. Each has one untimed run on the
smallest data set before, so that code generation and JVM warm-up are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marketloom import session  # noqa: E402
from marketloom.plans import REGISTRY, Views  # noqa: E402

HEADLINES = [
    "adjusted_bars_qfq",
    "stored_or_computed_bars",
    "intraday_bars",
    "same_bucket_amount_ratio",
    "intraday_features",
    "latest_line_per_key",
    "inserted_if_absent",
    "canonical_bars",
    "provider_conflicts",
    "merged_records",
    "quality_scores",
    "coverage_matrix",
    "golden_matches",
    "research_cards",
    "weighted_medians",
    "clustered_events",
    "corroborated_relations",
    "simhash_signatures",
    "duplicate_bodies",
    "triaged_hits",
    "selected_passages",
    "daily_report",
    "payload_hashes",
    "stream_tumbling_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    if small.exists():
        for name in HEADLINES:
            run(spark, name, str(small))
    timings = {name: round(run(spark, name, folder), 3) for name in HEADLINES}
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": scale}))
    spark.stop()


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    REGISTRY[name].build(Views(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


if __name__ == "__main__":
    main()
