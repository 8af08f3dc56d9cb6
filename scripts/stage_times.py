"""Summarise a Spark event log per job group (bench.py sets one group per query).

Usage: python scripts/stage_times.py <event log file or folder>
Prints, per group: jobs, stages, tasks, summed stage seconds, shuffle bytes written.
"""

from __future__ import annotations

import collections
import json
import os
import sys


def read_lines(path: str):
    """Lines of an event-log file; Spark 4 may compress rolled segments with zstd."""
    if path.endswith(".zstd") or path.endswith(".zst"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        yield from io.StringIO(data.decode("utf-8"))
    elif path.endswith(".lz4") or path.endswith(".snappy"):
        raise SystemExit(f"{path}: set spark.eventLog.compression.codec=zstd or disable compression")
    else:
        with open(path) as fh:
            yield from fh


def main():
    path = sys.argv[1]
    files = ([os.path.join(d, f) for d, _, fs in sorted(os.walk(path)) for f in sorted(fs) if not f.startswith(".")]
             if os.path.isdir(path) else [path])
    stage_group, jobs = {}, collections.Counter()
    agg = collections.defaultdict(lambda: {"stages": 0, "tasks": 0, "secs": 0.0, "shuffle_bytes": 0})
    for f in files:
        for line in read_lines(f):
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "-")
                    jobs[group] += 1
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    g = stage_group.get(info["Stage ID"], "-")
                    a = agg[g]
                    a["stages"] += 1
                    a["tasks"] += info.get("Number of Tasks", 0)
                    if info.get("Submission Time") and info.get("Completion Time"):
                        a["secs"] += (info["Completion Time"] - info["Submission Time"]) / 1000.0
                    for acc in info.get("Accumulables", []):
                        if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                            a["shuffle_bytes"] += int(acc.get("Value", 0))
    for g, a in sorted(agg.items(), key=lambda kv: -kv[1]["secs"]):
        print(f"{g:28s} jobs={jobs[g]:3d} stages={a['stages']:3d} tasks={a['tasks']:5d} "
              f"stage_secs={a['secs']:7.2f} shuffle_MB={a['shuffle_bytes'] / 1e6:8.2f}")


if __name__ == "__main__":
    main()
