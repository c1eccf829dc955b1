import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from shopframe.operators import stock
from shopframe.plans.prefix import grouped_running_sum
from shopframe.plans.ranking import global_row_number


def brute_allocation(lines, stocks):
    """Reference fold on the driver, for tiny fixtures only."""
    out = {}
    by_p = {}
    for pid, oid, iid, q in lines:
        by_p.setdefault(pid, []).append((oid, iid, q))
    for pid, ls in by_p.items():
        if pid not in stocks:
            for oid, iid, q in ls:
                out[(pid, iid)] = (False, 404)
            continue
        r = stocks[pid]
        for oid, iid, q in sorted(ls):
            ok = q <= r
            if ok:
                r -= q
            out[(pid, iid)] = (ok, 200 if ok else 400)
    return out


def _random_case(seed, hot=False):
    rnd = random.Random(seed)
    stocks = {p: rnd.randint(0, 30) for p in range(1, 6)}
    lines = []
    for n in range(rnd.randint(5, 60)):
        pid = 1 if hot and rnd.random() < 0.6 else rnd.randint(1, 7)  # 6, 7 unknown
        oid = rnd.randint(1, 40)
        lines.append((pid, oid, f"{oid}-{n}", rnd.randint(0, 12)))
    return lines, stocks


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("block_rows", [2048, 1, 3])
def test_sequential_allocation_matches_fold(spark, seed, block_rows):
    lines, stocks = _random_case(seed, hot=seed % 2 == 0)
    ldf = spark.createDataFrame(lines, "product_id INT, order_id INT, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame(list(stocks.items()), "product_id INT, stock INT")
    got = {
        (r.product_id, r.order_item_id): (r.accepted, r.code)
        for r in stock.sequential_allocation(ldf, pdf, block_rows=block_rows).collect()
    }
    assert got == brute_allocation(lines, stocks)


def test_apply_allocation_and_per_product(spark):
    lines = [(1, 1, "1-1", 5), (1, 2, "2-1", 5), (1, 3, "3-1", 2), (2, 1, "1-2", 9)]
    ldf = spark.createDataFrame(lines, "product_id INT, order_id INT, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame([(1, 8), (2, 3)], "product_id INT, stock INT")
    alloc = stock.sequential_allocation(ldf, pdf)
    assert rows(alloc, "order_item_id", "accepted") == [("1-1", True), ("1-2", False), ("2-1", False), ("3-1", True)]
    assert rows(stock.apply_allocation(pdf, alloc)) == [(1, 1), (2, 3)]
    per = stock.stock_after_demand(pdf, ldf)
    assert rows(per) == [(1, 8, 400), (2, 3, 400)]
    per2 = stock.stock_after_demand(pdf, ldf.where("quantity < 5"))
    assert rows(per2) == [(1, 6, 200), (2, 3, 200)]


def test_stock_check_codes(spark):
    orders = spark.createDataFrame([(1,), (2,)], "order_id INT")
    items = spark.createDataFrame([(10, 5), (11, 50)], "order_item_id INT, quantity INT")
    products = spark.createDataFrame([(100, "bolt", 20)], "product_id INT, name STRING, stock INT")
    req = spark.createDataFrame(
        [(None, None, None), (9, 10, 100), (1, 99, 100), (1, 10, 999), (2, 11, 100), (1, 10, 100)],
        "order_id INT, order_item_id INT, product_id INT",
    )
    got = rows(stock.stock_check(req, orders, items, products), "order_id", "order_item_id", "product_id", "code", "p_name", "quantity")
    assert got == [
        (1, 10, 100, 200, "bolt", 20),
        (1, 10, 999, 404, None, None),
        (1, 99, 100, 404, None, None),
        (2, 11, 100, 422, "bolt", 20),
        (9, 10, 100, 404, None, None),
        (None, None, None, 400, None, None),
    ]


def test_running_sum_hot_group(spark):
    rnd = random.Random(7)
    data = [(1 if rnd.random() < 0.7 else rnd.randint(2, 5), rnd.randint(0, 1000), i, rnd.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "g INT, o INT, i INT, v INT")
    ranked = global_row_number(df, ["g", "o", "i"], "rk")
    got = grouped_running_sum(ranked, "g", "rk", "v", "cs", block_rows=16)
    w = Window.partitionBy("g").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("cs", F.sum("v").over(w))
    assert rows(got, "g", "o", "i", "cs") == rows(want, "g", "o", "i", "cs")


def test_global_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = global_row_number(df, ["k"], "rn")
    assert sorted(tuple(r) for r in got.select("k", "rn").collect()) == [(k, k + 1) for k in range(1000)]


def test_allocation_outcome_per_order(spark):
    lines = [(1, 1, "1-1", 5), (1, 2, "2-1", 50), (9, 2, "2-2", 1), (1, 3, "3-1", 1)]
    ldf = spark.createDataFrame(lines, "product_id INT, order_id INT, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame([(1, 8)], "product_id INT, stock INT")
    alloc = stock.sequential_allocation(ldf, pdf)
    paid = spark.createDataFrame([(1,), (2,), (3,), (4,)], "order_id INT")
    got = rows(stock.allocation_outcome(paid, alloc), "order_id", "code")
    assert got == [(1, 200), (2, 500), (3, 200), (4, 404)]


def test_stock_check_parses_text_ids(spark):
    orders = spark.createDataFrame([(1,)], "order_id INT")
    items = spark.createDataFrame([(10, 5)], "order_item_id INT, quantity INT")
    products = spark.createDataFrame([(100, "bolt", 20)], "product_id INT, name STRING, stock INT")
    req = spark.createDataFrame([("1abc", "10", "100"), ("x", "y", "z"), ("x", "10", "100")],
                                "order_id STRING, order_item_id STRING, product_id STRING")
    got = [r.code for r in stock.stock_check(req, orders, items, products).collect()]
    assert sorted(got) == [200, 400, 404]


def test_passes_with_integer_line_ids(spark):
    lines = [(1, o, o * 10 + i, q) for o, i, q in [(1, 1, 4), (1, 2, 9), (2, 1, 3), (3, 1, 1), (3, 2, 2)]]
    ldf = spark.createDataFrame(lines, "product_id INT, order_id INT, order_item_id INT, quantity INT")
    pdf = spark.createDataFrame([(1, 8)], "product_id INT, stock INT")
    got = {r.order_item_id: r.accepted for r in stock.sequential_allocation(ldf, pdf, block_rows=1).collect()}
    assert got == {11: True, 12: False, 21: True, 31: True, 32: False}


def allocated(spark, lines, stocks, **more):
    ldf = spark.createDataFrame(lines, "product_id INT, order_id INT, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame(list(stocks.items()), "product_id INT, stock INT")
    return {(r.product_id, r.order_item_id): (r.accepted, r.code)
            for r in stock.sequential_allocation(ldf, pdf, **more).collect()}


def counted_passes(monkeypatch):
    passes = []
    one = stock._pass
    monkeypatch.setattr(stock, "_pass", lambda *a: (passes.append(1), one(*a))[1])
    return passes


def test_hot_product_of_several_blocks(spark):
    rnd = random.Random(99)
    n_hot = stock.BLOCK_ROWS + 500
    lines = [(1, rnd.randint(1, 5000), f"h{i}", rnd.randint(1, 9)) for i in range(n_hot)]
    lines += [(p, rnd.randint(1, 5000), f"s{p}-{i}", rnd.randint(1, 9)) for p in (2, 3) for i in range(40)]
    stocks = {1: 3000, 2: 50, 3: 10_000}
    assert allocated(spark, lines, stocks) == brute_allocation(lines, stocks)


@pytest.mark.parametrize("quantity", ["falling", "rising", "halving", "all sizes"])
def test_passes_follow_the_digits_of_the_stock(spark, monkeypatch, quantity):
    # 5,000 lines of different quantities, in blocks of 64: one pass per
    # binary digit at most, not one per quantity or block
    rnd = random.Random(7)
    size = {
        "falling": lambda i: 5000 - i, "rising": lambda i: i + 1, "halving": lambda i: 1 << (12 - i % 13),
        "all sizes": lambda i: int(2 ** rnd.uniform(0, 17)),
    }[quantity]
    lines = [(1, i, f"h{i}", size(i)) for i in range(5000)] + [(2, i, f"s{i}", i % 5 + 1) for i in range(300)]
    stocks = {1: 100_003, 2: 77}
    passes = counted_passes(monkeypatch)
    assert allocated(spark, lines, stocks, block_rows=64) == brute_allocation(lines, stocks)
    assert len(passes) <= 17  # 100,003 has 17 binary digits


def test_a_product_of_one_block_takes_one_pass(spark, monkeypatch):
    lines = [(1, i, f"h{i}", 1500 - i) for i in range(1500)]
    passes = counted_passes(monkeypatch)
    assert allocated(spark, lines, {1: 20_000}) == brute_allocation(lines, {1: 20_000})
    assert len(passes) <= 2  # ranks of one product may lie in two blocks


FIVE = [(1, 10, "a", 3), (1, 10, "a", 3), (1, 11, "b", 5), (1, 11, "b", 1), (1, 12, "c", 1)]
LINES = "product_id INT, order_id INT, order_item_id STRING, quantity INT"


@pytest.mark.parametrize("block_rows", [2048, 1])
def test_repeated_line_ids_stay_separate_lines(spark, block_rows):
    ldf = spark.createDataFrame(FIVE, LINES)
    pdf = spark.createDataFrame([(1, 8)], "product_id INT, stock INT")
    got = rows(stock.sequential_allocation(ldf, pdf, block_rows=block_rows), "order_item_id", "quantity", "accepted")
    # 3 and 3 leave 2, then 1 (before 5, by quantity) leaves 1, 5 is refused, 1 leaves 0
    assert got == [("a", 3, True), ("a", 3, True), ("b", 1, True), ("b", 5, False), ("c", 1, True)]


@pytest.mark.parametrize("block_rows", [2048, 1])
def test_odd_quantities_and_stocks(spark, block_rows):
    lines = [(1, 1, "a", None), (1, 2, "b", 0), (1, 3, "c", -4), (1, 4, "d", 9), (2, 1, "e", 0), (2, 2, "f", 1), (3, 1, "g", 1), (3, 2, "h", 0)]
    pdf = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "product_id INT, stock INT")
    got = {r.order_item_id: (r.accepted, r.code) for r in stock.sequential_allocation(
        spark.createDataFrame(lines, LINES), pdf, block_rows=block_rows).collect()}
    assert got == {"a": (True, 200), "b": (True, 200), "c": (False, 400), "d": (False, 400), "e": (False, 400),
                   "f": (False, 400), "g": (False, 400), "h": (True, 200)}


@pytest.mark.parametrize("kind,first,step", [("INT", 1_000_000, 1), ("BIGINT", 10**17, 10**13)])
def test_wide_ids_and_many_partitions(spark, kind, first, step):
    lines = [(1, first + i * step, f"{i}", 1 + i % 3) for i in range(60)] + [(1, first + 3_000_000, "z", 1)]
    ldf = spark.createDataFrame(lines, f"product_id INT, order_id {kind}, order_item_id STRING, quantity INT")
    pdf = spark.createDataFrame([(1, 50)], "product_id INT, stock INT")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {(r.product_id, r.order_item_id): (r.accepted, r.code)
               for r in stock.sequential_allocation(ldf, pdf, block_rows=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_allocation(lines, {1: 50})


def test_narrow_id_range_spreads_over_blocks(spark):
    # one outlier id next to a narrow range: blocks follow ranks, not ids
    data = [(1, i, 1) for i in range(2000)] + [(1, 10**12, 1)]
    ranked = global_row_number(spark.createDataFrame(data, "g INT, o BIGINT, v INT"), ["g", "o"], "rk")
    per_block = ranked.groupBy(F.floor(F.col("rk") / 64)).count()
    assert per_block.agg(F.max("count")).first()[0] <= 64 and per_block.count() >= 31


def test_one_row_request_moves_no_line_table(spark):
    items = spark.createDataFrame([(i, i // 3, i % 7) for i in range(5000)], "order_item_id INT, order_id INT, quantity INT").repartition(4)
    orders = spark.range(2000).select(F.col("id").cast("int").alias("order_id"))
    products = spark.createDataFrame([(100, "bolt", 20)], "product_id INT, name STRING, stock INT")
    req = spark.createDataFrame([(1, 5, 100)], "order_id INT, order_item_id INT, product_id INT")
    out = stock.stock_check(req, orders, items, products)
    assert [r.code for r in out.collect()] == [200]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the line scan meets the requested ids before any exchange that feeds an aggregate
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]


def test_a_hot_product_of_the_requests_is_split(spark):
    # a third of the requests on one product, tables too large to broadcast
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    n = 30_000
    req = spark.range(n).select(
        F.col("id").cast("int").alias("order_id"), (F.col("id") * 2).cast("int").alias("order_item_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("int").alias("product_id"),
    ).repartition(8)
    items = spark.range(n).select(F.col("id").cast("int").alias("order_item_id"), F.col("id").cast("int").alias("order_id"), F.lit(2).alias("quantity"))
    orders = spark.range(n - 10).select(F.col("id").cast("int").alias("order_id"))
    products = spark.range(4000).select(F.col("id").cast("int").alias("product_id"), F.lit("x").alias("name"), F.lit(5).alias("stock"))
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = stock.stock_check(req, orders, items, products)
        assert out.groupBy("code").count().count() == 2
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == n and "skew=true" in plan.split("Initial Plan")[0]
    want = sum(1 for i in range(n) if i < n - 10 and 2 * i < n and (7 if i % 3 == 0 else i % 5000) < 4000)
    assert sum(r.code == 200 for r in got) == want


def test_a_product_ends_with_its_last_block(spark, monkeypatch):
    # 3 of the stock are left, but there is no line for another pass
    lines = [(1, 1, "a", 7), (1, 2, "b", 7)]
    passes = counted_passes(monkeypatch)
    assert allocated(spark, lines, {1: 10}) == {(1, "a"): (True, 200), (1, "b"): (False, 400)}
    assert len(passes) == 1


def test_outcomes_read_the_ranked_lines_once(spark):
    lines = spark.createDataFrame([(1, o, f"{o}", 4) for o in range(9)] + [(2, 3, "x", 1), (9, 4, "y", 1)], LINES)
    pdf = spark.createDataFrame([(1, 8), (2, 5)], "product_id INT, stock INT")
    alloc = stock.sequential_allocation(lines, pdf)
    got = rows(stock.allocation_outcome(lines.select("order_id").distinct(), alloc), "order_id", "code")
    assert got == [(o, 200 if o < 2 else 500) for o in range(9)]
    plan = alloc._jdf.queryExecution().executedPlan().toString()
    # the lines themselves, and the sizes of their partitions
    assert sum("ExistingRDD" in x and "order_item_id" in x for x in plan.splitlines()) <= 2
