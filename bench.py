"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma separated, or
"all") may be set. Each query runs once to warm up and then BENCH_RUNS times;
the median counts. Results go to the noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from jointframe.queries import load_all
from jointframe.session import Tables, discard_tables, local_session

HEADLINE = [
    "kinematic_closure", "world_poses", "forward_kinematics", "seed_to_object", "material_class_earliest", "material_properties",
    "movement_text_documents", "part_centroid", "normalise_object", "axis_radius", "proximity_pairs", "split_dedup", "shard_assign",
    "output_completeness", "mutation_expand", "obj_faces", "accounting_scan", "stage_stats", "resource_rollup", "trimmed_hist",
    "crash_reasons", "fuzzy_match", "instance_boxes", "covisibility", "asof_tag", "box_overlap", "relation_semi", "violation_report",
    "sessions", "latest_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    registry = load_all()
    names = list(registry) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "bench")
    tables = Tables(spark, folder)
    times: dict[str, float] = {}
    for name in names:
        def once() -> float:
            start = time.perf_counter()
            registry[name].build(tables).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        first = once()
        times[name] = round(statistics.median([once() for _ in range(runs)]) if runs else first, 3)
        discard_tables(spark)
        print(f"{name} {first:.2f} {times[name]:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
