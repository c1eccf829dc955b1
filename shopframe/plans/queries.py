"""Registered queries: one per inventory item checked against an oracle.

Each query takes ``(spark, sf_dir)``, reads the whole test tables through
the shop mapping and returns a DataFrame whose column names and types equal
the oracle's.  Most are lazy plans; the iterative and streaming ones
(allocation, id allocation, guarded inserts, the order stream, the CSV
restore) run their intermediate jobs - checkpoints into the shared
checkpoint folder, the micro-batches, the backup - when called, and return a
DataFrame over those results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import spec
from ..functions.scalars import line_total
from ..operators import changes, integrity, lookups, metrics, stock, views
from ..session import scratch_path
from ..sources import csv_transfer, store
from ..sources import requests as req
from ..sources.shop_tables import ShopTables
from ..streaming import order_changes

REPORT_YEAR = 1998


def q_orders_by_month_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ShopTables(spark, sf_dir)
    return metrics.orders_by_month_status(t.orders(), REPORT_YEAR)


def q_monthly_status_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ShopTables(spark, sf_dir)
    return metrics.monthly_status_dataset(t.orders(), REPORT_YEAR, extra_statuses=("Pending",))


def q_orders_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "orders")


def q_order_item_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "order_item")


def q_products_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "products")


def q_catalog(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return views.catalog(t.products(), t.categories())


def q_products_in_category(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return views.products_in_category(t.products(), t.categories(), "Brand#2").select("product_id", "name")


def q_users_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "users")


def q_delivery_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "delivery_details")


def q_categories_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "categories")


def q_testimonial_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "customer_testimonial")


def q_newsletter_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "newsletter")


def q_slide_show_view(spark, sf_dir):
    return views.table_view(ShopTables(spark, sf_dir), "slide_show")


def q_orders_view_by_ids(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return views.table_view(t, "orders", ids=req.order_requests(t.events())).select("order_id", "username")


def q_order_lines(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return lookups.lookup(
        t.order_item(), "order_id", req.order_requests(t.events()),
        cols=["order_item_id", "order_id", "product_id", "quantity"],
    )


def q_login_lookup(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return lookups.find_login(t.users(), req.login_attempts(t.events())).select("user_id")


def q_order_subtotals(spark, sf_dir):
    return metrics.order_subtotals(ShopTables(spark, sf_dir).order_item())


def q_next_ids(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    # the test data's line ids are text, so order_item has no next one
    return metrics.next_ids({n: (t.table(n), spec(n).key[0]) for n in ("orders", "users", "delivery_details")})


def q_next_ids_after_truncate(spark, sf_dir):
    # H6: the emptied tables start anew; the others go on
    t = ShopTables(spark, sf_dir)
    tables = {n: t.table(n) for n in ("orders", "users", "delivery_details")}
    emptied = {n: changes.truncate(tables[n], confirm=True) for n in ("orders", "delivery_details")}
    return metrics.next_ids({n: (df, spec(n).key[0]) for n, df in (tables | emptied).items()}).join(
        _counts((tables | emptied).items()), "t"
    )


def q_latest_draft(spark, sf_dir):
    return metrics.latest_order(ShopTables(spark, sf_dir).orders(), "draft")


def q_first_pending(spark, sf_dir):
    return metrics.first_order(ShopTables(spark, sf_dir).orders(), "Pending")


def q_stock_check(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return stock.stock_check(req.stock_requests(t.order_item()), t.orders(), t.order_item(), t.products()).select(
        "order_item_id", "order_id", "product_id", "p_name", "quantity", "code"
    )


def q_product_demand(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return metrics.product_demand(t.order_item(), t.orders(), "paid")


def q_stock_after_demand(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return stock.stock_after_demand(t.products(), stock.paid_lines(t.order_item(), t.orders()))


def q_stock_sequential(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    alloc = stock.sequential_allocation(stock.paid_lines(t.order_item(), t.orders()), t.products())
    return alloc.select("product_id", "order_item_id", "accepted", "code")


def q_paid_order_outcomes(spark, sf_dir):
    # per paid order: 404 without lines, 500 if any line was refused, else 200
    t = ShopTables(spark, sf_dir)
    orders = t.orders()
    alloc = stock.sequential_allocation(stock.paid_lines(t.order_item(), orders), t.products())
    paid = orders.where(F.col("status") == "paid").select("order_id")
    return stock.allocation_outcome(paid, alloc).select("order_id", "code")


def q_line_totals(spark, sf_dir):
    li = ShopTables(spark, sf_dir).order_item()
    return li.select("order_item_id", line_total("quantity", "price").cast("double").alias("total"))


def q_upsert_products(spark, sf_dir):
    # staged: twice the number of each sold product, so half are new; the
    # price is missing where the product has an even number of lines
    t = ShopTables(spark, sf_dir)
    staged = t.order_item().groupBy((F.col("product_id") * 2).alias("product_id")).agg(
        F.when(F.count(F.lit(1)) % 2 == 1, F.max("price")).alias("price")
    )
    return changes.upsert(t.products(), staged, ["product_id"], ["price"]).select("product_id", "price")


def q_update_with_fallback(spark, sf_dir):
    # stock updates after paid demand; a zero result is falsy and keeps the
    # old stock, as ``new || old`` does
    t = ShopTables(spark, sf_dir)
    p = t.products()
    demand = metrics.product_demand(t.order_item(), t.orders(), "paid")
    upd = p.join(demand, "product_id", "inner").select(
        "product_id", F.greatest(F.col("stock") - F.col("demand"), F.lit(0)).alias("stock"),
        F.lit(1).alias("seq"),
    )
    new, _ = changes.apply_updates(p, upd, ["product_id"], ["stock"], seq="seq", mode="falsy")
    return new.select("product_id", "stock")


def q_newsletter_signups(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    batch = req.newsletter_signups(t.events())
    acc, rej = changes.guarded_insert(t.newsletter(), batch, [("email", False)], ["ts"], "event_id")
    return acc.select("event_id", "email", F.lit(201).alias("code")).unionByName(
        rej.join(batch.select("event_id", "email"), "event_id").select("event_id", "email", "code")
    )


def q_register_users(spark, sf_dir):
    # H2 with two guards (username, e-mail; case-insensitive) and H1 ids
    t = ShopTables(spark, sf_dir)
    users = t.users()
    batch = req.user_registrations(t.events()).select(
        "event_id", "ts", F.lower("username").alias("username"), F.lower("email").alias("email")
    )
    acc, rej = changes.guarded_insert(
        users, batch, [("username", True), ("email", True)], ["ts", "event_id"], "event_id"
    )
    ids = changes.allocate_ids(users, acc, "user_id", ["ts", "event_id"])
    return ids.select("event_id", F.lit(201).alias("code"), "user_id").unionByName(
        rej.select("event_id", "code", F.lit(None).cast(users.schema["user_id"].dataType).alias("user_id"))
    )


def q_insert_orders(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    batch = req.new_orders(t.events()).withColumn("status", F.lit("draft"))
    rows = changes.allocate_ids(t.orders(), batch, "order_id", ["ts", "event_id"])
    return rows.select("event_id", "order_id")


def q_delete_by_ids(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    new, _ = changes.apply_deletes(t.orders(), req.deletion_requests(t.events()), "order_id")
    return new.select("order_id")


def q_approval_notices(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    return changes.approval_notices(req.status_changes(t.events()), t.orders())


def q_export_orders(spark, sf_dir):
    return csv_transfer.export_projection(ShopTables(spark, sf_dir).orders(), "orders")


def q_restore_orders(spark, sf_dir):
    # the backup holds the orders of the users seen in the events; since then
    # every order was set to draft and those named by error events were
    # deleted.  Restored: known rows take the backup's values, deleted ones
    # come back if the backup has them, all others stay as they are
    t = ShopTables(spark, sf_dir)
    orders = t.orders()
    backup = lookups.in_ids(orders, "user_id", t.events().select("user_id").distinct())
    path = csv_transfer.export_csv(backup, "orders", scratch_path(spark, "orders-backup"))
    drafts = orders.select("order_id", F.lit("draft").alias("status"), F.lit(1).alias("seq"))
    changed, _ = changes.update_table("orders", orders, drafts, as_of="2024-02-01 00:00:00")
    damaged, _ = changes.delete_table("orders", changed, req.deletion_requests(t.events()))
    staged = csv_transfer.read_export_csv(spark, path, "orders", orders.schema)
    restored = csv_transfer.restore_table(damaged, staged, "orders")
    return csv_transfer.export_projection(restored, "orders")


def q_order_status_updates(spark, sf_dir):
    # H4 as a batch job: the whole status-change feed applied to orders in
    # (ts, event_id) order with the falsy fallback; unknown orders rejected
    t = ShopTables(spark, sf_dir)
    chg = req.status_changes(t.events()).withColumn("seq", F.struct("ts", "event_id")).drop("ts", "event_id")
    new, _ = changes.update_table("orders", t.orders(), chg, seq="seq", as_of="2024-02-01 00:00:00")
    return new.select("order_id", "status")


def q_category_resolution(spark, sf_dir):
    # product changes naming their category by name, resolved to ids; larger
    # products name their type, which is no category
    t = ShopTables(spark, sf_dir)
    name = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))
    chg = t.raw("part").select(F.col("p_partkey").alias("product_id"), name.alias("category"))
    ok, bad = changes.resolve_category(chg, t.categories())
    return ok.select("product_id", "category_id", F.lit(200).alias("code")).unionByName(
        bad.select("product_id", F.lit(None).cast("int").alias("category_id"), "code")
    )


def q_users_view_by_ids(spark, sf_dir):
    # keyed users view: the administrator account is shown here
    t = ShopTables(spark, sf_dir)
    ids = t.raw("events").select("user_id").distinct()
    return views.table_view(t, "users", ids=ids)


def _streamed(spark, sf_dir) -> tuple[ShopTables, str]:
    # the events file is the stream source; each micro-batch is applied by
    # foreachBatch and the final table is the base plus the change log
    t = ShopTables(spark, sf_dir)
    root = order_changes.run_order_change_stream(
        spark, sf_dir, t.orders(), order_item=t.order_item(), products=t.products(),
        file_glob="events.parquet",
    )
    return t, root


def q_order_change_stream(spark, sf_dir):
    t, root = _streamed(spark, sf_dir)
    return order_changes.current_orders(spark, t.orders(), root).select("order_id", "status")


def q_paid_transitions(spark, sf_dir):
    _, root = _streamed(spark, sf_dir)
    return spark.read.parquet(f"{root}/{order_changes.PAID}").select("order_id", "event_id")


def q_paid_request_outcomes(spark, sf_dir):
    _, root = _streamed(spark, sf_dir)
    return spark.read.parquet(f"{root}/{order_changes.OUTCOMES}").select("order_id", "event_id", "code")


def q_stock_after_stream(spark, sf_dir):
    t, root = _streamed(spark, sf_dir)
    left = order_changes.current_stock(spark, t.products(), root)
    return left.select("product_id", F.col("stock").cast("bigint").alias("stock"))


def q_order_item_view_orphans(spark, sf_dir):
    # the view after orders named by error events were deleted: their lines
    # stay (no cascade) and show the marker text
    t = ShopTables(spark, sf_dir)
    left, _ = changes.delete_table("orders", t.orders(), req.deletion_requests(t.events()))
    return views.order_item_enriched(t.order_item(), t.products(), left, t.users())


def q_username_lookup(spark, sf_dir):
    # Exact, case included
    t = ShopTables(spark, sf_dir)
    return lookups.lookup(t.users(), "username", req.login_attempts(t.events()).select("login"), cols=["user_id", "username"])


def q_delete_summary(spark, sf_dir):
    t = ShopTables(spark, sf_dir)
    _, summary = changes.delete_table("orders", t.orders(), req.deletion_requests(t.events()))
    return summary


def q_status_update_rejects(spark, sf_dir):
    # changes to orders of which some were removed
    t = ShopTables(spark, sf_dir)
    left = lookups.not_in_ids(t.orders(), "order_id", t.events().where("value > 100").select("user_id"))
    chg = req.status_changes(t.events()).withColumn("seq", F.struct("ts", "event_id"))
    _, rejects = changes.update_table("orders", left, chg)
    return rejects.select("order_id", "code", "reason")


def q_numbered_orders(spark, sf_dir):
    # H1 with given ids: 201 with the id, or 409
    t = ShopTables(spark, sf_dir)
    batch = req.numbered_orders(t.events()).withColumn("status", F.lit("draft"))
    fine, rejects = changes.key_conflicts(t.orders(), batch, "order_id", ["ts"], "event_id")
    ids = changes.allocate_ids(t.orders(), fine, "order_id", ["ts", "event_id"])
    return ids.select("event_id", "order_id", F.lit(201).alias("code")).unionByName(
        rejects.select("event_id", F.lit(None).cast("bigint").alias("order_id"), "code")
    )


def q_insert_users(spark, sf_dir):
    # H1/H2 for users: lower-cased, is_disabled false unless given
    t = ShopTables(spark, sf_dir)
    users = t.users()
    flags = t.events().select("event_id", F.when(F.col("value") > 50, F.lit(True)).alias("is_disabled"))
    batch = req.user_registrations(t.events()).join(flags, "event_id")
    new, _ = changes.insert_table("users", users, batch, ["ts", "event_id"], "event_id", as_of="2024-02-01 00:00:00")
    return new.select("user_id", "username", "email", "is_disabled")


def q_register_shared_emails(spark, sf_dir):
    # H2 with both guards clashing inside the feed
    t = ShopTables(spark, sf_dir)
    acc, rej = changes.guarded_insert(
        t.users(), req.shared_email_registrations(t.events()), [("username", True), ("email", True)], ["ts", "event_id"], "event_id"
    )
    return acc.select("event_id", F.lit(201).alias("code"), F.lit(None).cast("string").alias("reason")).unionByName(
        rej.select("event_id", "code", "reason")
    )


def q_update_products(spark, sf_dir):
    # H3 with C9, G8 and G12: empty names and zero stocks keep the old value,
    # the price is text, is_disabled always applies, unknown categories reject
    t = ShopTables(spark, sf_dir)
    p = t.raw("part")
    chg = p.select(
        F.col("p_partkey").alias("product_id"), F.lit(1).alias("seq"),
        F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.upper("p_name")).alias("name"),
        (F.col("p_size") % 5).alias("stock"), (F.col("p_size") > 10).alias("is_disabled"),
        F.concat((F.col("p_size") * 2).cast("string"), F.lit(".5 each")).alias("price"),
        F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_brand")).alias("category"),
    )
    new, _ = changes.update_products(t.products(), t.categories(), chg, as_of="2024-02-01 00:00:00")
    return new.select("product_id", "name", "stock", "price", "is_disabled", "category_id")


MAPPED_TABLES = (
    "orders", "order_item", "delivery_details", "users", "products", "categories",
    "customer_testimonial", "newsletter", "slide_show",
)


def _counts(frames) -> DataFrame:
    out = None
    for name, df in frames:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _digests(frames) -> DataFrame:
    out = None
    for name, df in frames:
        one = csv_transfer.content_digest(df, name).select(F.lit(name).alias("t"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def q_export_all(spark, sf_dir):
    # A5: every table exported; the rows found in each export and a digest of
    # their content
    t = ShopTables(spark, sf_dir)
    root = scratch_path(spark, "export-all")
    report = csv_transfer.export_all(spark, t.table, root, MAPPED_TABLES).select(F.col("table").alias("t"), "ok")
    found = _digests(
        (n, csv_transfer.read_export_csv(spark, f"{root}/{n}", n, t.table(n).schema)) for n in MAPPED_TABLES
    )
    return report.join(found, "t")


#: Loaded lines may repeat an id, with another quantity.
RESTORE_KEYS = {"order_item": ("order_item_id", "quantity")}


def q_restore_all(spark, sf_dir):
    # Every table restored from its export into a version that lost rows
    # and has other texts in some of those left
    t = ShopTables(spark, sf_dir)
    backup, store_root = scratch_path(spark, "backup"), scratch_path(spark, "store")
    csv_transfer.export_all(spark, t.table, backup, MAPPED_TABLES, compression="gzip")
    # written once for all tables: its size tells the planner how to join it
    lost_ids = scratch_path(spark, "lost-ids")
    t.events().select("user_id").distinct().write.parquet(lost_ids)
    lost = spark.read.parquet(lost_ids)
    altered = {"orders": "description", "users": "user_type", "products": "name", "delivery_details": "status",
               "customer_testimonial": "comment", "slide_show": "title"}

    def damaged(name: str) -> DataFrame:
        if name == "order_item":
            return t.order_item().join(lost.withColumnRenamed("user_id", "order_id"), "order_id", "left_anti")
        left = lookups.not_in_ids(t.table(name), spec(name).key[0], lost)
        return left.withColumn(altered[name], F.lit("?")) if name in altered else left

    report = csv_transfer.restore_all(spark, damaged, backup, store_root, MAPPED_TABLES, RESTORE_KEYS)
    found = _digests((n, store.read_current(spark, store_root, n)) for n in MAPPED_TABLES)
    return report.select(F.col("table").alias("t"), "ok").join(found, "t")


def _deleted(spark, sf_dir) -> Callable[[str], DataFrame]:
    """The tables after deletes that did not cascade: orders of error events,
    customers of sign-up events, products named by both."""
    t = ShopTables(spark, sf_dir)
    events = t.events()
    ids = {
        "orders": req.deletion_requests(events),
        "users": events.where("event_type = 'signup'").select("user_id"),
        "products": events.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("product_id")),
    }

    def load(name: str) -> DataFrame:
        return changes.delete_table(name, t.table(name), ids[name])[0] if name in ids else t.table(name)

    return load


def q_orphan_report(spark, sf_dir):
    return integrity.orphan_report(_deleted(spark, sf_dir), MAPPED_TABLES)


def q_orphan_summary(spark, sf_dir):
    return integrity.orphan_summary(_deleted(spark, sf_dir), MAPPED_TABLES)


def q_orphan_lines(spark, sf_dir):
    return integrity.orphan_rows(_deleted(spark, sf_dir), "order_item", MAPPED_TABLES).select(
        "order_item_id", "quantity", F.array_join("missing", ",").alias("missing")
    )


def q_stock_check_text_ids(spark, sf_dir):
    # Ids as the text of request paths, against numeric keys
    t = ShopTables(spark, sf_dir)
    return stock.stock_check(req.text_id_requests(t.events()), t.orders(), t.order_item(), t.products()).select(
        "event_id", "order_id", "product_id", "code", "error"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "orders_by_month_status": q_orders_by_month_status,
    "monthly_status_dataset": q_monthly_status_dataset,
    "orders_view": q_orders_view,
    "order_item_view": q_order_item_view,
    "products_view": q_products_view,
    "catalog": q_catalog,
    "products_in_category": q_products_in_category,
    "users_view": q_users_view,
    "delivery_view": q_delivery_view,
    "categories_view": q_categories_view,
    "testimonial_view": q_testimonial_view,
    "newsletter_view": q_newsletter_view,
    "slide_show_view": q_slide_show_view,
    "orders_view_by_ids": q_orders_view_by_ids,
    "order_lines": q_order_lines,
    "login_lookup": q_login_lookup,
    "order_subtotals": q_order_subtotals,
    "next_ids": q_next_ids,
    "latest_draft": q_latest_draft,
    "first_pending": q_first_pending,
    "stock_check": q_stock_check,
    "product_demand": q_product_demand,
    "stock_after_demand": q_stock_after_demand,
    "stock_sequential": q_stock_sequential,
    "paid_order_outcomes": q_paid_order_outcomes,
    "line_totals": q_line_totals,
    "upsert_products": q_upsert_products,
    "update_with_fallback": q_update_with_fallback,
    "newsletter_signups": q_newsletter_signups,
    "register_users": q_register_users,
    "insert_orders": q_insert_orders,
    "delete_by_ids": q_delete_by_ids,
    "approval_notices": q_approval_notices,
    "export_orders": q_export_orders,
    "restore_orders": q_restore_orders,
    "order_change_stream": q_order_change_stream,
    "order_status_updates": q_order_status_updates,
    "category_resolution": q_category_resolution,
    "users_view_by_ids": q_users_view_by_ids,
    "paid_transitions": q_paid_transitions,
    "paid_request_outcomes": q_paid_request_outcomes,
    "stock_after_stream": q_stock_after_stream,
    "order_item_view_orphans": q_order_item_view_orphans,
    "username_lookup": q_username_lookup,
    "delete_summary": q_delete_summary,
    "status_update_rejects": q_status_update_rejects,
    "numbered_orders": q_numbered_orders,
    "insert_users": q_insert_users,
    "register_shared_emails": q_register_shared_emails,
    "update_products": q_update_products,
    "export_all": q_export_all,
    "restore_all": q_restore_all,
    "orphan_report": q_orphan_report,
    "orphan_summary": q_orphan_summary,
    "orphan_lines": q_orphan_lines,
    "next_ids_after_truncate": q_next_ids_after_truncate,
    "stock_check_text_ids": q_stock_check_text_ids,
}
