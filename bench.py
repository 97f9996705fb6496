"""Headline queries, run whole and timed; prints one JSON line.

Each query is written to Spark's noop sink, so every output row is computed.
A first run at the same scale warms the JVM; the median of BENCH_REPS runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cuewright.plans.registry import catalog
from cuewright.session import local_session

HEADLINE = (
    "gate_take", "best_take", "candidate_topk", "beam_assemble", "timeline_offsets", "phrase_reset", "hard_gate_survives",
    "shadow_rank", "agreement", "pairs_self_join", "rank_within_phrase", "by_class", "latest_revision", "ranking_training_rows",
    "idempotent_ingest", "measure_pitch", "audio_gate", "playback_metrics", "mode_analysis", "blind_order",
    "parse_batch_text", "split_phrases", "normalize_pronunciation", "content_align",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "12g"))
    queries = {name: run for name, (run, _) in catalog().items()}

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(reps)), 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds_warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "spark": spark.version, "reps": reps,
            }
        )
    )


if __name__ == "__main__":
    main()
