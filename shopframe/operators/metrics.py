"""Aggregates (D1-D5) and top-1 picks.

Every aggregate here is decomposable, so Spark computes a partial aggregate
in each scan task and shuffles only one row per group and task; a hot group
(one user or product holding a large share of rows) is pre-aggregated before
the shuffle instead of landing whole in one task.  The top-1 picks use
``max``/``min`` over a struct rather than a ranking window for the same
reason: a window would sort a hot user's rows in one task.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, month_name

# The statuses the monthly dataset always reports (0 if absent).
MONTHLY_STATUSES = ("paid", "pending_approval", "draft")


def year_filter(df: DataFrame, col: str, year: int | None) -> DataFrame:
    """Rows whose timestamp falls in ``year`` (default: the current year, as
    the shop's report does), written as a range on the raw column so the
    predicate reaches the Parquet scan (``year(c) = y`` would not be pushed)."""
    if year is None:
        year = datetime.date.today().year
    dtype = df.schema[col].dataType.simpleString()
    lo = F.lit(f"{year}-01-01 00:00:00").cast(dtype)
    hi = F.lit(f"{year + 1}-01-01 00:00:00").cast(dtype)
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def orders_by_month_status(orders: DataFrame, year: int | None = None, ts_col: str = "created_at") -> DataFrame:
    """D1 + E3: order count per (month name, status) of one year, sorted by
    month name like the reference (alphabetical)."""
    return (
        year_filter(orders, ts_col, year)
        .groupBy(month_name(ts_col).alias("month"), F.col("status"))
        .agg(F.count(F.lit(1)).alias("count"))
        # 12 months by few statuses: the sort is over the grouped rows
        .orderBy("month", "status")
    )


def monthly_status_dataset(
    orders: DataFrame,
    year: int | None = None,
    extra_statuses: Iterable[str] = (),
    with_other: bool = False,
    ts_col: str = "created_at",
) -> DataFrame:
    """D1 pivoted wide, one row per month.

    ``paid``, ``pending_approval`` and ``draft`` are always present (0 when
    absent); ``extra_statuses`` adds one count column per named status.  With
    ``with_other`` the counts of every status not given a column are kept in
    a ``other`` map (status -> count; a null status is keyed ``"null"``).
    One aggregation with conditional counts - no separate pass to discover
    pivot values.
    """
    fixed = list(MONTHLY_STATUSES) + [s for s in extra_statuses if s not in MONTHLY_STATUSES]
    if not with_other:
        aggs = [F.count_if(F.col("status") == s).alias(s) for s in fixed]
        return (
            year_filter(orders, ts_col, year)
            .groupBy(month_name(ts_col).alias("month"))
            .agg(*aggs)
            .orderBy("month")
        )
    # two-level: (month, status) counts first, then one row per month; the
    # second level sees at most one row per distinct status and month
    # a null status and the text "null" share a key, so they are counted
    # together before the map is made
    status_key = F.coalesce(F.col("status"), F.lit("null"))
    per_status = (
        year_filter(orders, ts_col, year)
        .groupBy(month_name(ts_col).alias("month"), status_key.alias("status"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    others = F.filter(
        F.collect_list(F.struct(F.col("status").alias("k"), F.col("count").alias("v"))),
        lambda e: ~e["k"].isin(fixed),
    )
    aggs = [F.sum(F.when(F.col("status") == s, F.col("count")).otherwise(0)).alias(s) for s in fixed]
    return per_status.groupBy("month").agg(
        *aggs, F.map_from_entries(others).alias("other")
    ).orderBy("month")


def order_subtotals(order_item: DataFrame) -> DataFrame:
    """D3: sum of line totals per order (orders without lines give no row).
    Each value is DECIMAL(18,2) before summing, so the result does not depend
    on summation order; it is returned as DOUBLE."""
    return order_item.groupBy("order_id").agg(
        F.sum(F.col("total").cast(MONEY)).cast("double").alias("total")
    )


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row ``next_id = max(key) + 1`` (1 for an empty table)."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def next_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """D4 for several tables: rows ``(t, next_id)``."""
    out = None
    for name, (df, key) in tables.items():
        one = next_id(df, key).select(F.lit(name).alias("t"), "next_id")
        out = one if out is None else out.unionByName(one)
    return out


def product_demand(order_item: DataFrame, orders: DataFrame, status: str = "paid") -> DataFrame:
    """Total ordered quantity per product over orders in ``status``."""
    wanted = orders.where(F.col("status") == status).select("order_id")
    return (
        order_item.join(wanted, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").cast("bigint").alias("demand"))
    )


def _pick(orders: DataFrame, status: str, latest: bool, ts_col: str) -> DataFrame:
    """Two aggregates of plain columns, both hash-based and combined on the
    map side: the best id of each (user, time), then the id of the best time."""
    agg, by = (F.max, F.max_by) if latest else (F.min, F.min_by)
    per_time = (
        orders.where(F.col("status") == status)
        .groupBy("user_id", ts_col).agg(agg("order_id").alias("order_id"))
    )
    # a null time never wins against a time, but is an order all the same
    best = per_time.groupBy("user_id").agg(
        by("order_id", ts_col).alias("_timed"), agg(F.when(F.col(ts_col).isNull(), F.col("order_id"))).alias("_untimed")
    )
    return best.select("user_id", F.coalesce("_timed", "_untimed").alias("order_id"))


def latest_order(orders: DataFrame, status: str = "draft", ts_col: str = "created_at") -> DataFrame:
    """Each user's latest order in ``status`` (ties: larger id)."""
    return _pick(orders, status, True, ts_col)


def first_order(orders: DataFrame, status: str = "Pending", ts_col: str = "created_at") -> DataFrame:
    """Each user's first order in ``status`` (ties: smaller id)."""
    return _pick(orders, status, False, ts_col)
