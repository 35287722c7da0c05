"""Headline queries, timed end to end into a no-op sink. Prints one JSON line.

``queries`` holds the first run of each in a warm session, code generation included;
``warm`` a second run of the same query.

environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores)
"""
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from catalog import ENTRIES  # noqa: E402
from catalog.views import points  # noqa: E402
from scangrid.session import build_session  # noqa: E402

HEADLINE = [
    "uniform_grid", "grid_distance", "grid_ground", "grid_semantic", "grid_adaptive",
    "policy_band_storage", "common_support_scores", "scores_overall_and_band", "assign_points",
    "motion_residual", "road_proximity", "object_proposals", "ground_plane", "occupancy_grid",
    "voxel_occupancy", "resample_blocks", "latency_distribution", "block_bootstrap_ci",
    "lovasz_softmax", "stream_uniform_grid"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    n = points(spark, sf).count()  # also warms up the scan
    names = sys.argv[1:] or HEADLINE
    times, warm = {}, {}
    for name in names:
        for into in (times, warm):  # the first run also compiles the plan's code
            start = time.perf_counter()
            ENTRIES[name][0](spark, sf).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], warm[name], file=sys.stderr, flush=True)
    rates = {q: round(n / times[q]) for q in times if q.startswith("grid_") or q == "uniform_grid"}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "warm": warm, "points": n, "points_per_sec": rates,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
