"""Skew-safe running sums.

A running sum per group is a window ``partitionBy(group).orderBy(...)``;
planned directly, every row of a group goes to one task, so a group holding a
third of all rows would sort a third of the data in one task.  Here each
group is cut into blocks of consecutive *ranks* (``plans.ranking``): rows get
a running sum inside ``(group, block)`` - at most ``BLOCK_ROWS`` rows, however
the ids are spread - and block totals (a decomposable aggregate) are turned
into per-block offsets by a window over one row per block.  The result
equals the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most; a group's blocks spread over all tasks.
BLOCK_ROWS = 8192


def grouped_running_sum(
    df: DataFrame, group: str, rank: str, value: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same ``group`` up to and
    including this row in ``rank`` order.  ``rank`` is a global row number:
    unique over all rows, so a block of ranks has a bounded number of rows."""
    with_blk = df.withColumn("_blk", F.floor(F.col(rank) / F.lit(block_rows)))
    w_local = (
        Window.partitionBy(group, "_blk").orderBy(rank)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = with_blk.withColumn("_lcs", F.sum(value).over(w_local))
    totals = with_blk.groupBy(group, "_blk").agg(F.sum(value).alias("_bt"))
    w_off = (
        Window.partitionBy(group).orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        group, "_blk", F.coalesce(F.sum("_bt").over(w_off), F.lit(0)).alias("_off")
    )
    return (
        local.join(offsets, [group, "_blk"], "inner")
        .withColumn(out, F.col("_lcs") + F.col("_off"))
        .drop("_blk", "_lcs", "_off")
    )
