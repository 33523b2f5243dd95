"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and run to completion with the ``noop`` sink (all rows
produced, nothing collected to the driver).  Prints ONE JSON line on stdout:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Progress goes to stderr.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    os.environ.setdefault("AUTOKPI_SHUFFLE_PARTITIONS", str(max(8, cpus)))
    from autokpi.plans.registry import QUERIES, load_all
    from autokpi.session import get_spark

    spark = get_spark(master=f"local[{cpus}]")
    load_all()
    names = [n for n in QUERIES if not only or any(p in n for p in only)]
    # Warm-up (reported in the output): every query once on the smallest data
    # set, so JIT and whole-stage-codegen caches are filled as in a running
    # service; the timed pass then measures query work, not class loading.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t_warm = time.perf_counter()
    if warm and os.path.isdir(warm):
        for name in names:
            try:
                QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 — the timed pass reports failures
                pass
    t_warm = round(time.perf_counter() - t_warm, 3)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
            print(f"{name}: {times[name]:.2f}s", file=sys.stderr)
        except Exception as exc:  # noqa: BLE001 — reported, bench continues
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            print(f"{name}: FAILED {failed[name]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "flagship_w1_sec": times.get("w1_kpi_metrics_events"),
        "sync_l1_sec": times.get("l1_sync_kpis"),
        "n_queries": len(times),
        "warmup": {"dir": warm, "sec": t_warm},
        "failed": failed,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
