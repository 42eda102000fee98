"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and the parse of a 74 MB transcript; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmeter.session import SETTINGS

HEADLINE = ["cost_by_label", "cost_by_model", "usage_dedup_max", "cost_rollup_total", "label_model_grouping_sets", "top_sessions", "baseline_by_label", "spend_trend", "sticky_segments", "asof_child_segment", "ordered_merge", "dashboard_top10"]
RUNS, TRANSCRIPT_BYTES = 3, 74_000_000


def transcript(root: str) -> None:
    """One session's log of about 74 MB: prompts, streamed answers that repeat their request, long texts."""
    os.makedirs(f"{root}/project")
    filler, size, n = "word " * 120, 0, 0
    with open(f"{root}/project/session.jsonl", "w", encoding="utf-8") as file:
        while size < TRANSCRIPT_BYTES:
            ts = f"2026-01-{n // 20000 % 28 + 1:02d}T10:{n // 60 % 60:02d}:{n % 60:02d}Z"
            if n % 10:
                usage = {"input_tokens": n, "output_tokens": n % 1000, "cache_read_input_tokens": 5}
                record = {"type": "assistant", "timestamp": ts, "requestId": f"r{n // 3}", "message": {"role": "assistant", "model": "m-1", "usage": usage, "content": [{"type": "text", "text": filler}]}}
            else:
                record = {"type": "user", "timestamp": ts, "message": {"role": "user", "content": f"<command-name>/step{n % 7}</command-name> {filler}"}}
            size += file.write(json.dumps(record) + "\n")
            n += 1


def timed(make: Callable[[], DataFrame]) -> float:
    times = []
    for _ in range(RUNS):  # the first run also compiles
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from sparkmeter.adapters import claude
    from sparkmeter.plans.registry import queries

    known = queries()
    took = {name: timed(lambda name=name: known[name](spark, sf_dir)) for name in HEADLINE}
    total = round(sum(took.values()), 3)
    with tempfile.TemporaryDirectory() as root:
        transcript(root)
        took["jsonl_requests_74mb"] = timed(lambda: claude.sessions(spark, root)["requests"])
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
