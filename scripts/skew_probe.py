"""Skew probe for the sequential stock allocation.

Moves every paid order line of an even product id onto product 1 (about half
of all paid lines on one key), gives that product a large stock, runs
``sequential_allocation`` (the hot product is decided block by block,
in passes) and checks the result against a sequential fold computed on the
driver.  The driver-side fold is verification only; it is not library code.

Usage: python scripts/skew_probe.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from shopframe.operators import stock  # noqa: E402
from shopframe.session import build_session, checkpoint_root  # noqa: E402
from shopframe.sources.shop_tables import ShopTables  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    checkpoint_root(spark)
    t = ShopTables(spark, sf_dir)
    lines = stock.paid_lines(t.order_item(), t.orders())
    hot = lines.withColumn(
        "product_id", F.when(F.col("product_id") % 2 == 0, F.lit(1)).otherwise(F.col("product_id"))
    )
    products = t.products().withColumn(
        "stock", F.when(F.col("product_id") == 1, F.lit(250_000)).otherwise(F.col("stock"))
    )
    t0 = time.perf_counter()
    alloc = stock.sequential_allocation(hot, products)
    got = {(r.product_id, r.order_item_id): r.accepted
           for r in alloc.select("product_id", "order_item_id", "accepted").collect()}
    spark_s = time.perf_counter() - t0

    rows = hot.join(products.select("product_id", "stock"), "product_id").select(
        "product_id", "order_id", "order_item_id", "quantity", "stock").collect()
    by_product: dict = {}
    for r in rows:
        by_product.setdefault(r.product_id, [r.stock, []])[1].append((r.order_id, r.order_item_id, r.quantity))
    want = {}
    for pid, (left, ls) in by_product.items():
        for _, item, q in sorted(ls):
            ok = q <= left
            left -= q if ok else 0
            want[(pid, item)] = ok
    hot_lines = sum(1 for k in got if k[0] == 1)
    print(f"lines={len(got)} hot_product_lines={hot_lines} accepted={sum(want.values())} "
          f"exact={got == want} spark_seconds={spark_s:.1f}")
    spark.stop()
    return 0 if got == want else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
