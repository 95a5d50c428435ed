"""What every job reads and moves, from Spark's event log: all jobs it starts
count, those that write staged tables included.

usage: python tools/plan_summary.py [sf_dir] [key ...]
Each job is run once with a ``noop`` sink on a session whose event log goes to
a fresh scratch folder. Prints a markdown table (the body of PLANS.md).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkwell.plans import QUERIES  # noqa: E402
from inkwell.session import get_spark  # noqa: E402

COLS = ["scans (rows read)", "staged rows read", "Spark jobs", "shuffles", "rows shuffled", "joins", "windows", "Python"]


def read_log(path: str) -> dict[str, dict]:
    """Per job key: Spark jobs, scans with rows, shuffled rows, plan nodes."""
    out = defaultdict(lambda: {"jobs": 0, "scan": Counter(), "rows": Counter(), "written": 0, "nodes": Counter()})
    stage_key, exec_key, plans, metric = {}, {}, {}, {}
    tasks = []
    for line in open(path):
        e = json.loads(line)
        kind = e["Event"].rpartition(".")[2]
        if kind == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            if key := props.get("spark.jobGroup.id"):
                out[key]["jobs"] += 1
                stage_key.update(dict.fromkeys(e["Stage IDs"], key))
                if x := props.get("spark.sql.execution.id"):
                    exec_key[int(x)] = key
        elif "sparkPlanInfo" in e:
            plans[e["executionId"]] = e["sparkPlanInfo"]
        elif kind == "SparkListenerTaskEnd":
            tasks.append(e)

    def walk(node, into):
        name = node["nodeName"].split(" (")[0].strip()
        into[name] += 1
        place = (node.get("metadata") or {}).get("Location", "")
        for m in node["metrics"]:
            if m["name"] == "number of output rows" and place:
                metric[m["accumulatorId"]] = place
        for child in node["children"]:
            walk(child, into)

    for x, plan in plans.items():
        if x in exec_key:
            walk(plan, out[exec_key[x]]["nodes"])
    seen = defaultdict(set)
    for e in tasks:
        if (key := stage_key.get(e["Stage ID"])) is None:
            continue
        m = e.get("Task Metrics") or {}
        out[key]["written"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
        for a in e["Task Info"].get("Accumulables", []):
            if a["ID"] in metric and str(a.get("Update", "")).isdigit():
                place = metric[a["ID"]]
                table = re.search(r"/(\w+)\.parquet", place)
                name = table[1] if table and "inkwell-stage" not in place else "staged"
                out[key]["rows"][name] += int(a["Update"])
                seen[key].add((name, a["ID"]))
    for key, found in seen.items():
        out[key]["scan"] = Counter(name for name, _ in found)
    return out


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    folder = tempfile.mkdtemp(prefix="inkwell-events-")
    spark = get_spark(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}",
                             "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                             "spark.sql.maxMetadataStringLength": "2000"})
    for k in keys:
        spark.sparkContext.setJobGroup(k, k)
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    log = read_log(os.path.join(folder, os.listdir(folder)[0]))
    print("| job | " + " | ".join(COLS) + " |")
    print("|---" * (len(COLS) + 1) + "|")
    for k in keys:
        r = log[k]
        n = r["nodes"]
        scans = " ".join(f"{t}{'×' + str(c) if c > 1 else ''} ({r['rows'][t]})" for t, c in sorted(r["scan"].items())
                         if t != "staged")
        count = lambda p, n=n: sum(v for name, v in n.items() if re.search(p, name))
        row = [scans or "-", r["rows"]["staged"] or "-", r["jobs"], count("^Exchange$"), r["written"], count("Join$"),
               count("^Window"), count("Pandas|Python|Arrow")]
        print(f"| `{k}` | " + " | ".join(map(str, row)) + " |", flush=True)


if __name__ == "__main__":
    main()
