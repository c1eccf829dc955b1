"""Summarise a Spark event log: the slowest stages with task counts, run time
and shuffle volumes.  Usage: python scripts/stage_times.py <event_log> [top_n]
(<event_log> is the file or the folder Spark wrote).
"""

from __future__ import annotations

import json
import os
import sys


def _lines(path):
    # Spark 4 writes a folder of rolling event files (zstd by default); older
    # versions a single plain file
    files = [os.path.join(path, f) for f in sorted(os.listdir(path))] if os.path.isdir(path) else [path]
    for fp in files:
        name = os.path.basename(fp)
        if name.startswith((".", "appstatus")) or name.endswith(".crc"):
            continue
        if fp.endswith(".zstd"):
            import io

            import zstandard

            with open(fp, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(fp) as f:
                yield from f


def main(argv):
    path = argv[1]
    top = int(argv[2]) if len(argv) > 2 else 15
    stages = {}
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerTaskEnd":
            m = ev.get("Task Metrics") or {}
            st = stages.setdefault(ev["Stage ID"], {"tasks": 0, "run_ms": 0, "shuffle_read": 0, "shuffle_write": 0})
            rd = m.get("Shuffle Read Metrics") or {}
            st["tasks"] += 1
            st["run_ms"] += m.get("Executor Run Time", 0)
            st["shuffle_read"] += rd.get("Remote Bytes Read", 0) + rd.get("Local Bytes Read", 0)
            st["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            st = stages.setdefault(info["Stage ID"], {"tasks": 0, "run_ms": 0, "shuffle_read": 0, "shuffle_write": 0})
            st["name"] = info.get("Stage Name", "")[:60]
            st["wall_ms"] = (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0)
    rows = sorted(stages.items(), key=lambda kv: -kv[1].get("wall_ms", 0))[:top]
    print(f"{'stage':>6} {'wall_ms':>8} {'tasks':>6} {'run_ms':>8} {'shuf_rd_MB':>10} {'shuf_wr_MB':>10}  name")
    for sid, st in rows:
        print(f"{sid:>6} {st.get('wall_ms', 0):>8} {st['tasks']:>6} {st['run_ms']:>8} "
              f"{st['shuffle_read'] / 1e6:>10.1f} {st['shuffle_write'] / 1e6:>10.1f}  {st.get('name', '')}")


if __name__ == "__main__":
    main(sys.argv)
