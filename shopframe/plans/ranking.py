"""Global row numbering without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into
one task.  Instead the rows are range-partitioned and sorted by the order
columns (the sort is distributed), each row records its partition and its
position inside it, the partition sizes (one row per partition - a bounded
table) are turned into offsets, and the offsets are broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "rn") -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order`` (which should
    be a total order; ties are numbered in an arbitrary but fixed way)."""
    checkpoint_root(df.sparkSession)
    sorted_ = (
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        # fix partition contents so the sizes and the rows agree even if a
        # task is re-run
        .checkpoint(eager=True)
    )
    sizes = sorted_.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window below sees a bounded table
    offsets = sizes.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    return (
        sorted_.join(F.broadcast(offsets), "_pid", "inner")
        .withColumn(out, F.col("_off") + F.col("_pos") + 1)
        .drop("_pid", "_pos", "_off")
    )
