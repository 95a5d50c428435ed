"""Per-stage task statistics from Spark's event log (no UI, no server).

usage: python tools/stage_report.py [sf_dir] key [key ...]

Runs each job with the ``noop`` sink and the event log written to a fresh
scratch folder, then prints per stage: tasks, median and max task time, the
max/median ratio (skew) and shuffle bytes read/written.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkwell.plans import QUERIES  # noqa: E402
from inkwell.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    keys = [a for a in args if not a.startswith("/")]
    log_dir = tempfile.mkdtemp(prefix="inkwell-eventlog-")
    spark = get_spark(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                             "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext
    for k in keys:
        sc.setJobGroup(k, k)
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group: dict[int, str] = {}
    tasks: dict[int, list[float]] = defaultdict(list)
    shuffle: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    job_group: dict[int, str] = {}
    for path in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    g = props.get("spark.jobGroup.id", "?")
                    job_group[ev["Job ID"]] = g
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    sid = ev["Stage ID"]
                    tasks[sid].append((info["Finish Time"] - info["Launch Time"]) / 1000.0)
                    m = ev.get("Task Metrics") or {}
                    shuffle[sid][0] += (m.get("Shuffle Read Metrics") or {}).get("Remote Bytes Read", 0) + \
                        (m.get("Shuffle Read Metrics") or {}).get("Local Bytes Read", 0)
                    shuffle[sid][1] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    print(f"event log: {log_dir}")
    print(f"{'job':26s} {'stage':>5s} {'tasks':>5s} {'median_s':>8s} {'max_s':>6s} {'skew':>5s} {'shuf_rd':>9s} {'shuf_wr':>9s}")
    for sid in sorted(tasks):
        d = tasks[sid]
        med = statistics.median(d)
        skew = max(d) / med if med > 0 else float("nan")
        print(f"{stage_group.get(sid, '?'):26s} {sid:5d} {len(d):5d} {med:8.3f} {max(d):6.3f} {skew:5.1f} "
              f"{shuffle[sid][0]:9d} {shuffle[sid][1]:9d}")


if __name__ == "__main__":
    main()
