"""Order-change stream (I1 with H4, H8, H9 and H7).

A Structured Streaming query reads change events from a file source and
hands each micro-batch to ``foreachBatch``.  The batch job:

1. maps events to status changes and rejects changes to unknown orders;
2. takes each order's changes in ``(ts, event_id)`` order, beginning with the
   status before the batch - the latest change already logged for those
   orders (semi join on the batch's ids, never a scan-and-collect), else the
   base status - and derives *every* transition to ``paid`` (H8), as every
   request of the shop does, not only the last change of a batch;
3. appends each order's latest change to a change log, the approval notices
   (H9) to an outbox and the transitions to a table; each transition gets a
   sequential stock allocation (H7), in transition order, against the stock
   left by earlier batches.

Every output is partitioned by ``batch_id`` and written with dynamic
partition overwrite, so a replayed batch (after a failure, the engine
re-runs the last uncommitted batch) replaces its own rows and nothing else:
the sink is idempotent.  Last write wins by event time, not arrival: a change
older than the logged one is no longer applied.  Events that arrive in time
order give the same log, transitions, allocations, outcomes and stock however
they are cut into batches.

The current order table is a view: base orders with the latest logged change
applied (``current_orders``); ``fold_into_base`` writes it as a new base
version, and every ``COMPACT_EVERY`` batches a snapshot of the folded state
bounds what a batch reads.

Why ``foreachBatch`` and explicit state tables rather than a built-in stateful
operator: each batch needs the state *before* it (to detect transitions to
``paid`` and to allocate stock against what earlier batches took) and writes
several outputs that must be replay-safe together; a keyed ``max`` in the
state store would give the new latest change but not the old one.  No
watermark is needed: nothing is windowed, the state is one row per order
(bounded by the orders table), and late events are handled by comparing
event times, not by dropping them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import stock as st
from ..plans.ranking import global_row_number
from ..session import checkpoint_root, is_absent_path_error, scratch_path
from ..sources.requests import status_changes

LOG = "change_log"
NOTICES = "notices"
PAID = "paid_transitions"
ALLOC = "allocations"
OUTCOMES = "stock_outcomes"
SNAPSHOTS = "snapshots"
MANIFEST = "manifest"

LOG_SCHEMA = "order_id BIGINT, ts TIMESTAMP_NTZ, event_id BIGINT, status STRING, batch_id BIGINT"
LAST_TYPE = "struct<ts:timestamp_ntz,event_id:bigint,status:string>"
# A snapshot of the folded state is written every this many batches, so a
# batch reads one snapshot plus at most this many log partitions instead of
# the whole history.
COMPACT_EVERY = 50


def _write_partition(df: DataFrame, root: str, name: str, batch_id: int, col: str = "batch_id") -> None:
    (
        df.withColumn(col, F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(col)
        .parquet(os.path.join(root, name))
    )


def _read(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame | None:
    path = os.path.join(root, name)
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
        df.schema  # noqa: B018 - resolve now: a missing folder fails here
        return df
    except Exception as e:  # noqa: BLE001
        if is_absent_path_error(e):  # nothing written yet
            return None
        raise


def _snapshot_upto(spark: SparkSession, root: str, name: str, before_batch: int | None) -> int | None:
    """Newest snapshot of ``name`` covering batches < ``before_batch``.  The
    manifest has one row per snapshot, so this reads a handful of rows."""
    man = _read(spark, os.path.join(root, SNAPSHOTS), MANIFEST, "name STRING, upto BIGINT")
    if man is None:
        return None
    man = man.where(F.col("name") == name)
    if before_batch is not None:
        man = man.where(F.col("upto") < before_batch)
    return man.agg(F.max("upto")).first()[0]


def _state_rows(
    spark: SparkSession, root: str, name: str, schema: str, before_batch: int | None,
    only: DataFrame | None, key: str,
) -> DataFrame | None:
    """Rows of log ``name`` for batches < ``before_batch``: the newest
    snapshot (partition-pruned) plus the log partitions written after it;
    restricted to the keys in ``only`` before anything is aggregated."""
    up = _snapshot_upto(spark, root, name, before_batch)
    parts = []
    if up is not None:
        snap = _read(spark, os.path.join(root, SNAPSHOTS), name)
        parts.append(snap.where(F.col("upto") == up).drop("upto"))
    log = _read(spark, root, name, schema)
    if log is not None:
        if up is not None:
            log = log.where(F.col("batch_id") > up)
        if before_batch is not None:
            log = log.where(F.col("batch_id") < before_batch)
        parts.append(log.drop("batch_id"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if only is not None:
        out = out.join(only.select(key).distinct(), key, "left_semi")
    return out


def latest_changes(
    spark: SparkSession, root: str, before_batch: int | None = None, only: DataFrame | None = None
) -> DataFrame | None:
    """Latest logged change per order ``(order_id, last)`` where ``last`` is
    a struct ``(ts, event_id, status)``; a decomposable max, pre-aggregated
    per task."""
    rows = _state_rows(spark, root, LOG, LOG_SCHEMA, before_batch, only, "order_id")
    if rows is None:
        return None
    if "last" not in rows.columns:
        rows = rows.withColumn("last", F.lit(None).cast(LAST_TYPE))
    for c, t in (("ts", "timestamp_ntz"), ("event_id", "bigint"), ("status", "string")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    cand = F.coalesce(F.col("last"), F.struct("ts", "event_id", "status"))
    return rows.groupBy("order_id").agg(F.max(cand).alias("last"))


def taken_stock(
    spark: SparkSession, root: str, before_batch: int | None = None, only: DataFrame | None = None
) -> DataFrame | None:
    """Stock taken per product by accepted allocations ``(product_id, taken)``,
    for the products in ``only``."""
    rows = _state_rows(spark, root, ALLOC, None, before_batch, only, "product_id")
    if rows is None:
        return None
    if "taken" not in rows.columns:
        rows = rows.withColumn("taken", F.lit(None).cast("bigint"))
    if "accepted" not in rows.columns:
        rows = rows.withColumn("accepted", F.lit(None).cast("boolean")).withColumn("quantity", F.lit(None).cast("bigint"))
    amount = F.coalesce(F.col("taken"), F.when(F.col("accepted"), F.col("quantity")).otherwise(F.lit(0)))
    return rows.groupBy("product_id").agg(F.sum(amount).alias("taken"))


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Fold batches <= ``upto`` into snapshots and record them in the
    manifest.  Re-running it writes the same snapshot again."""
    snap_root = os.path.join(root, SNAPSHOTS)
    last = latest_changes(spark, root, before_batch=upto + 1)
    if last is not None:
        _write_partition(last, snap_root, LOG, upto, col="upto")
    taken = taken_stock(spark, root, before_batch=upto + 1)
    if taken is not None:
        _write_partition(taken, snap_root, ALLOC, upto, col="upto")
    names = [n for n, d in ((LOG, last), (ALLOC, taken)) if d is not None]
    spark.createDataFrame([(n, upto) for n in names], "name STRING, upto BIGINT").write.mode("append").parquet(
        os.path.join(snap_root, MANIFEST)
    )


def current_orders(spark: SparkSession, base_orders: DataFrame, state_root: str) -> DataFrame:
    """Orders with every logged change applied."""
    last = latest_changes(spark, state_root)
    if last is None:
        return base_orders
    return base_orders.join(last, "order_id", "left").withColumn(
        "status", F.coalesce(F.col("last.status"), F.col("status"))
    ).drop("last")


def fold_into_base(
    spark: SparkSession, base_orders: DataFrame, products: DataFrame | None, state_root: str, store_root: str
) -> dict[str, str]:
    """Write the current orders (and stock) as new versions in the table
    store, so a later stream can start from them with an empty log."""
    from ..sources.store import write_version

    out = {"orders": write_version(current_orders(spark, base_orders, state_root), store_root, "orders")}
    if products is not None:
        out["products"] = write_version(current_stock(spark, products, state_root), store_root, "products")
    return out


def current_stock(
    spark: SparkSession, products: DataFrame, state_root: str, before_batch: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Products with the stock left; only those in ``only`` if given."""
    if only is not None:
        products = products.join(only, "product_id", "left_semi")
    taken = taken_stock(spark, state_root, before_batch, only)
    if taken is None:
        return products
    return products.join(taken, "product_id", "left").withColumn(
        "stock", (F.col("stock") - F.coalesce(F.col("taken"), F.lit(0))).cast(products.schema["stock"].dataType)
    ).select(*products.columns)


def _with_status_before(changes: DataFrame) -> DataFrame:
    """Changes with ``_old``, the status their order had before each: that of
    the row before it in the global order, if it is the same order's, else
    ``_start``.  Ranks and an equi join, so an order with many changes is
    spread like any other rows."""
    ranked = global_row_number(changes, ["order_id", "ts", "event_id"], "_rank")
    before = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col("order_id").alias("_order"), F.col("status").alias("_was"))
    return ranked.join(before, "_rank", "left").withColumn(
        "_old", F.when(F.col("_order") == F.col("order_id"), F.col("_was")).otherwise(F.col("_start"))
    )


def _notices(known: DataFrame) -> DataFrame:
    """H9 for changes whose orders are known to exist."""
    return ch.approval_notices(known, known)


def apply_batch(
    spark: SparkSession,
    events: DataFrame,
    batch_id: int,
    base_orders: DataFrame,
    order_item: DataFrame | None,
    products: DataFrame | None,
    state_root: str,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """The per-batch job run by ``foreachBatch`` (also callable directly)."""
    base = base_orders.select("order_id", F.col("status").alias("_base_status"))
    # the orders are joined once: unknown ids go, known ones bring their status
    known = status_changes(events).join(base, "order_id").cache()
    steps = None
    try:
        prev = latest_changes(spark, state_root, before_batch=batch_id, only=known)
        if prev is not None:
            j = known.join(prev, "order_id", "left")
        else:
            j = known.withColumn("last", F.lit(None).cast(LAST_TYPE))
        fresh = F.col("last").isNull() | (F.struct("ts", "event_id") > F.struct("last.ts", "last.event_id"))
        newer = j.where(fresh).select(
            "order_id", "ts", "event_id", "status", F.coalesce(F.col("last.status"), F.col("_base_status")).alias("_start")
        )
        steps = _with_status_before(newer).cache()
        winners = steps.groupBy("order_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("new")).select(
            "order_id", "new.ts", "new.event_id", "new.status"
        )
        _write_partition(winners, state_root, LOG, batch_id)
        _write_partition(_notices(known), state_root, NOTICES, batch_id)
        paid = steps.where((F.col("status") == "paid") & ~F.col("_old").eqNullSafe("paid")).select("order_id", "ts", "event_id")
        _write_partition(paid, state_root, PAID, batch_id)
        if order_item is not None and products is not None and not paid.isEmpty():
            # an order that became paid twice has its lines taken twice
            lines = order_item.join(paid, "order_id")
            touched = lines.select("product_id").distinct()
            stock_now = current_stock(spark, products, state_root, before_batch=batch_id, only=touched)
            alloc = st.sequential_allocation(lines, stock_now, order=("ts", "event_id", "order_id", "order_item_id"))
            _write_partition(alloc, state_root, ALLOC, batch_id)
            schema = f"{alloc._jdf.schema().toDDL()}, batch_id BIGINT"
            written = _read(spark, state_root, ALLOC, schema)
            mine = alloc.limit(0) if written is None else written.where(F.col("batch_id") == batch_id).drop("batch_id")
            _write_partition(
                st.allocation_outcome(paid, mine, keys=("order_id", "event_id")), state_root, OUTCOMES, batch_id
            )
    finally:
        known.unpersist()
        if steps is not None:
            steps.unpersist()
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact(spark, state_root, batch_id)


def start_order_change_stream(
    spark: SparkSession,
    source_dir: str,
    base_orders: DataFrame,
    order_item: DataFrame | None = None,
    products: DataFrame | None = None,
    state_root: str | None = None,
    file_glob: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    compact_every: int = COMPACT_EVERY,
):
    """Start the stream; returns ``(query, state_root)``.

    ``source_dir`` holds event Parquet files (``file_glob`` selects some of
    them).  With ``available_now`` the query processes what is there and
    stops, which is how a scheduled job or a test drives it.
    """
    checkpoint_root(spark)
    state_root = state_root or scratch_path(spark, "order-stream")
    schema = spark.read.parquet(
        os.path.join(source_dir, file_glob) if file_glob else source_dir
    ).schema
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source_dir)

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        apply_batch(spark, batch_df, batch_id, base_orders, order_item, products, state_root, compact_every)

    writer = (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", os.path.join(state_root, "_stream_checkpoint"))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), state_root


def run_order_change_stream(spark: SparkSession, source_dir: str, base_orders: DataFrame, **kw) -> str:
    """Run the stream to completion over the files present; returns the
    state root holding the change log, notices and allocations."""
    q, root = start_order_change_stream(spark, source_dir, base_orders, available_now=True, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return root
