"""Summarise stage times from a Spark event log (no web UI needed).

    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tools/stage_times.py <that folder> [--top 20]

Prints the slowest stages with their task counts, and the total time per job.
Reads plain, rolled (``eventlog_v2_*``) and zstd-compressed logs.
"""

from __future__ import annotations

import argparse
import io
import json
import os
import sys


def _open(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"))
        return io.TextIOWrapper(raw, encoding="utf-8")
    return open(path, encoding="utf-8")


def _event_files(folder: str) -> list[str]:
    out = []
    for root, _, files in os.walk(folder):
        for f in sorted(files):
            if f.startswith(("events_", "local-", "app-")) and not f.endswith(".crc"):
                out.append(os.path.join(root, f))
    return out


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("folder")
    ap.add_argument("--top", type=int, default=20)
    args = ap.parse_args(argv[1:])
    stages, jobs = [], {}
    for path in _event_files(args.folder):
        for line in _open(path):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if "Submission Time" in si and "Completion Time" in si:
                    stages.append(
                        (si["Completion Time"] - si["Submission Time"], si["Stage ID"],
                         si["Number of Tasks"], si["Stage Name"])
                    )
            elif kind == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], None]
            elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]][1] = e["Completion Time"]
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {len(jobs)} jobs")
    print("slowest stages (ms, stage id, tasks, name):")
    for ms, sid, tasks, name in stages[: args.top]:
        print(f"  {ms:7d}  {sid:5d}  {tasks:5d}  {name[:70]}")
    total = sum(end - start for start, end in jobs.values() if end is not None)
    print(f"sum of job times: {total} ms")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
