"""Write the physical plan of every registered query to PLANS.md.

For each query: the operator tree of ``explain("formatted")`` and, per
Parquet scan, the pushed filters and the pruned read schema.  Usage:
python scripts/explain_plans.py [sf_dir] [out_file]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shopframe.plans.queries import QUERIES  # noqa: E402
from shopframe.session import build_session  # noqa: E402


SCALE_NOTES = """
## At 1000x the data

| Query family | Shuffles of the big input | Hot key (a third of rows on one key) | Broadcast |
|---|---|---|---|
| monthly dataset, subtotals, demand, next ids, top-1 picks | one, after partial aggregation | pre-aggregated per task before the shuffle | none |
| table views (`orders_view`, `order_item_view`, `delivery_view`, ...) | one per equi join on a big side (lines: by order id, by product id if products do not fit) | AQE splits skewed sort-merge partitions | sides estimated (10 MB) or measured under the threshold |
| keyed views and lookups (`*_by_ids`, `order_lines`, `login_lookup`) | semi join pushed to the scan of the big side | semi join keeps one row per key on the small side | request side if measured small |
| `stock_check` | the distinct requested ids; tables are cut down by semi joins before their exchanges, so a small request moves no table | the line lookup aggregates by (line id, order id) and then by line id, combined on the map side; the joins back hold one row per requested id on one side, and a hot requested id is not split there (that side is an aggregate) | if estimated or measured small |
| `stock_sequential`, `paid_order_outcomes` | one sort gives every line its rank (the one checkpointed copy); one count/sum aggregate, one join of narrow lines to the class table, passes over blocks, one join of the lines to their decision by rank | hot products leave the fold and run exact rounds with running sums over blocks of ranks; same rows either way | class table if measured small |
| upsert / fallback updates / deletes | one: both sides by key (the duplicate check reuses the join's exchange) | per-key aggregates are partial; staged keys are unique by check | none forced |
| `insert_orders` (id allocation) | one range-partitioned sort | range partitioning splits on the full order key | partition offsets (one row per partition) |
| guarded inserts | per-value `min` aggregates and equi joins on the row id | one guard: only a row per value meets the table; several guards: the anti joins with the table have plain exchanges on both sides, which AQE can split | none forced |
| CSV export / restore | export writes in parallel; restore reads many part files | n/a | none |
| order-change stream | per batch: the changes joined once with the orders, a ranked sort of the changes, a semi-joined read of state (one snapshot plus up to 50 log partitions), lines and products of the batch's paid orders only | status before a change comes from the rank before it, latest change per order from a partial max | none forced |
"""


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else os.path.join(ROOT, "PLANS.md")
    spark = build_session("local[8]", 8)
    parts = [
        "# Physical plans\n",
        SCALE_NOTES,
        f"Generated by `scripts/explain_plans.py` on `{sf_dir}` (`local[8]`, AQE on; the tree is the plan before\n"
        "adaptive re-planning, so joins AQE turns into broadcasts at run time still show as planned).\n",
    ]
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        txt = buf.getvalue()
        tree = txt.split("\n\n")[0].replace("== Physical Plan ==\n", "")
        scans = []
        for block in txt.split("\n\n")[1:]:
            if "Scan parquet" not in block:
                continue
            loc = re.search(r"Location: \w+ \[(.*?)\]", block)
            pf = re.search(r"PushedFilters: (.*)", block)
            rs = re.search(r"ReadSchema: (.*)", block)
            table = os.path.basename(loc.group(1)) if loc else "?"
            scans.append(f"- `{table}` pushed `{pf.group(1) if pf else '[]'}`, reads `{rs.group(1) if rs else ''}`")
        parts.append(f"\n## `{name}`\n\n```\n{tree}\n```\n" + ("\n".join(scans) + "\n" if scans else ""))
    with open(out, "w") as f:
        f.write("\n".join(parts))
    spark.stop()
    print(out)


if __name__ == "__main__":
    main(sys.argv)
