"""Bench: wall time per headline job at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each job is forced with the ``noop`` sink (the full plan runs, nothing is
collected). One warm-up pass runs every job once, then ``$BENCH_RUNS`` timed
rounds run them all again in turn; each job's time is its median. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkwell.plans import QUERIES  # noqa: E402
from inkwell.session import get_spark  # noqa: E402

# One or two headline jobs per fixture family (decode, trends, titles,
# schools, precincts, noise, enrichment, spatial).
HEADLINE = [
    "rank_with_total", "decode_variables", "sort_desc_share",
    "trend_table", "vintage_harmonize", "yearly_totals", "band_totals", "order_flip",
    "stats_by_category_decade", "topk_per_group",
    "vs_parent_benchmark", "gain_streak", "rank_within_cohort",
    "precinct_winner", "precinct_shares", "threshold_exceedance",
    "classify_rows", "model_scorecard",
    "point_in_area_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = sys.argv[1:] or HEADLINE
    spark = get_spark()
    def run(k: str) -> float:
        t0 = time.perf_counter()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for k in keys:                       # one warm-up pass over every job first
        run(k)
    samples: dict[str, list[float]] = {k: [] for k in keys}
    for _ in range(runs):                # then the timed rounds, interleaved
        for k in keys:
            samples[k].append(run(k))
    times = {k: round(statistics.median(v), 3) for k, v in samples.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "runs": runs}))


if __name__ == "__main__":
    main()
