"""The README's usage flow, end to end on a local table store."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shopframe.operators import changes, metrics, stock
from shopframe.sources import store
from shopframe.sources.shop_tables import ShopTables


def test_readme_flow(spark, tmp_out):
    root = os.path.join(tmp_out, "shop")
    t = ShopTables(spark, SF_SMALL)
    for name in ("orders", "order_item", "products"):
        store.write_version(t.table(name), root, name)
    t.raw("events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("order_id"), F.struct("ts", "event_id").alias("seq"), F.lit("paid").alias("status")
    ).write.parquet(os.path.join(root, "incoming", "order_changes"))

    orders = store.read_current(spark, root, "orders")
    items = store.read_current(spark, root, "order_item")
    products = store.read_current(spark, root, "products")
    assert metrics.monthly_status_dataset(orders, 1998).count() == 12
    alloc = stock.sequential_allocation(stock.paid_lines(items, orders), products)
    store.write_version(stock.apply_allocation(products, alloc), root, "products")
    taken = alloc.where("accepted").agg(F.sum("quantity")).first()[0]
    before = products.agg(F.sum("stock")).first()[0]
    after = store.read_current(spark, root, "products").agg(F.sum("stock")).first()[0]
    assert before - after == taken

    order_changes = spark.read.parquet(os.path.join(root, "incoming", "order_changes"))
    new_orders, rejects = changes.update_table("orders", orders, order_changes, seq="seq")
    store.write_version(new_orders, root, "orders")
    current = store.read_current(spark, root, "orders")
    touched = order_changes.select("order_id").distinct().join(orders.select("order_id"), "order_id", "left_semi")
    assert current.join(touched, "order_id", "left_semi").where("status <> 'paid'").count() == 0
    assert rejects.count() == order_changes.join(orders.select("order_id"), "order_id", "left_anti").count()


def test_scratch_goes_when_the_application_ends(tmp_out):
    import subprocess
    import sys

    from conftest import ROOT

    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from shopframe.session import build_session, scratch_path
spark = build_session("local[1]", 1, extra_conf={{"spark.checkpoint.dir": {tmp_out!r}}})
path = scratch_path(spark, "t")
spark.range(3).write.parquet(path)
assert path.startswith("file:" + {tmp_out!r}) and spark.read.parquet(path).count() == 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    left = [f for _, _, files in os.walk(tmp_out) for f in files if f.endswith(".parquet")]
    assert left == []
