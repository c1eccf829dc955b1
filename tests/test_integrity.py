"""Referential checks and content digests."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from shopframe.catalog import FOREIGN_KEYS, TABLES, spec
from shopframe.operators import changes, integrity
from shopframe.sources import csv_transfer, store


def shop(spark, **data):
    """Tables by name, with the named columns only."""
    schemas = {
        "orders": "order_id INT, user_id INT", "users": "user_id BIGINT", "products": "product_id INT, category_id INT",
        "order_item": "order_item_id INT, order_id INT, product_id BIGINT", "categories": "category_id INT",
        "delivery_details": "delivery_id INT, user_id INT, order_id INT",
    }
    frames = {n: spark.createDataFrame(data.get(n, []), schemas[n]) for n in schemas}
    return frames.__getitem__, list(schemas)


DATA = {
    "users": [(1,), (2,), (2,)], "categories": [(5,)], "products": [(10, 5), (11, None), (12, 6)],
    "orders": [(100, 1), (101, None), (102, 3), (103, 3)],
    "order_item": [(1, 100, 10), (2, 100, 99), (3, 999, 99), (4, None, 10), (5, 999, 12)] + [(6 + i, 100, 99) for i in range(50)],
    "delivery_details": [(1, 3, 100), (2, 1, 999)],
}
WANT = [
    ("delivery_details", "order_id", "orders", "999", 1), ("delivery_details", "user_id", "users", "3", 1),
    ("order_item", "order_id", "orders", "999", 2), ("order_item", "product_id", "products", "99", 52),
    ("orders", "user_id", "users", "3", 2), ("products", "category_id", "categories", "6", 1),
]


def test_report_and_summary(spark):
    load, tables = shop(spark, **DATA)
    assert rows(integrity.orphan_report(load, tables)) == WANT
    got = {(r.child, r.column): (r.referring, r.null_refs, r["keys"], r.missing_keys, r.orphans)
           for r in integrity.orphan_summary(load, tables).collect()}
    assert got[("order_item", "product_id")] == (55, 0, 3, 1, 52)
    assert got[("order_item", "order_id")] == (54, 1, 2, 1, 2)
    assert got[("orders", "user_id")] == (3, 1, 2, 1, 2)
    assert len(got) == len(FOREIGN_KEYS)


def test_rows_that_dangle(spark):
    load, tables = shop(spark, **DATA)
    got = {r.order_item_id: list(r.missing) for r in integrity.orphan_rows(load, "order_item", tables).collect()}
    assert got == {2: ["product_id"], 3: ["product_id", "order_id"], 5: ["order_id"], **{6 + i: ["product_id"] for i in range(50)}}
    assert integrity.orphan_rows(load, "users", tables).columns == ["user_id", "missing"]
    assert integrity.orphan_rows(load, "users", tables).count() == 0


def test_empty_and_missing_tables(spark):
    load, tables = shop(spark)
    assert integrity.orphan_report(load, tables).count() == 0
    load, _ = shop(spark, **DATA)
    only = integrity.orphan_report(load, ["orders", "users", "order_item"])
    assert rows(only) == [w for w in WANT if w[2] in ("orders", "users") and w[0] != "delivery_details"]
    with pytest.raises(ValueError):
        integrity.orphan_report(load, ["users", "products"])
    with pytest.raises(KeyError):
        integrity.orphan_report(load, ["users", "nothing"])


def test_hot_missing_key_is_counted_before_the_shuffle(spark):
    load, tables = shop(spark, **DATA)
    plan = integrity.orphan_report(load, tables)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftAnti"):]
    assert "Aggregate [child" in joined  # the references come counted into the join


def test_foreign_keys_are_catalog_columns():
    for child, column, parent in FOREIGN_KEYS:
        assert column in TABLES[child].column_names and len(spec(parent).key) == 1


TEXTS = [(1, "a", "x", 3, None, ""), (2, "", None, None, "t", "é"), (2, "", None, None, "t", "é")]
COLUMNS = "customer_testimonial_id INT, name STRING, comment STRING, rating INT, title STRING, avatar STRING"


def digest(df):
    return tuple(csv_transfer.content_digest(df, "customer_testimonial").first())


def test_digest_sees_what_counts_do_not(spark):
    base = digest(spark.createDataFrame(TEXTS, COLUMNS))
    assert base[0] == 3 and base == digest(spark.createDataFrame(TEXTS[::-1], COLUMNS).repartition(3))
    for i, c in enumerate(spark.createDataFrame(TEXTS, COLUMNS).columns):
        other = [list(r) for r in TEXTS]
        other[1][i] = 7 if c in ("customer_testimonial_id", "rating") else "other"
        assert digest(spark.createDataFrame(other, COLUMNS)) != base, c
    nulls = [(*TEXTS[0][:4], "", None), *TEXTS[1:]]  # a null and an empty text change places
    moved = [(1, "ax", "", 3, None, ""), *TEXTS[1:]]
    assert len({digest(spark.createDataFrame(t, COLUMNS))[1] for t in (TEXTS, nulls, moved, [*TEXTS[:2], (3, *TEXTS[2][1:])])}) == 4
    assert digest(spark.createDataFrame([], COLUMNS)) == (0, "0")


def test_restore_by_another_key(spark, tmp_out):
    schema = "order_item_id INT, quantity INT, price DECIMAL(18,2)"
    lines = spark.createDataFrame([(1, 2, 5), (1, 3, 6), (2, 2, 7)], "order_item_id INT, quantity INT, price INT")
    full = lines.select("order_item_id", "quantity", F.col("price").cast("decimal(18,2)").alias("price"))
    for c, t in TABLES["order_item"].columns:
        if c not in full.columns:
            full = full.withColumn(c, F.lit(None).cast(t))
    csv_transfer.export_all(spark, lambda n: full, f"{tmp_out}/b", ["order_item"])

    def load(_):
        return full.where("quantity = 3").withColumn("price", F.lit(0).cast("decimal(18,2)"))

    bad = csv_transfer.restore_all(spark, load, f"{tmp_out}/b", f"{tmp_out}/s1", ["order_item"]).first()
    assert not bad.ok  # the table's own key repeats
    keys = {"order_item": ("order_item_id", "quantity")}
    assert csv_transfer.restore_all(spark, load, f"{tmp_out}/b", f"{tmp_out}/s2", ["order_item"], keys).first().ok
    back = store.read_current(spark, f"{tmp_out}/s2", "order_item")
    assert rows(back, *[x.split()[0] for x in schema.split(", ")]) == rows(full, "order_item_id", "quantity", "price")


def test_last_run_before_the_first(spark, tmp_out):
    assert csv_transfer.last_run(spark, f"{tmp_out}/none").collect()[0].last_run is None
    csv_transfer.record_run(spark, f"{tmp_out}/none", "2024-01-02 03:04:05")
    assert str(csv_transfer.last_run(spark, f"{tmp_out}/none").first().last_run) == "2024-01-02 03:04:05"


def test_deletes_make_the_orphans(spark):
    load, tables = shop(spark, **DATA)
    left, _ = changes.delete_table("orders", load("orders"), spark.createDataFrame([(100,)], "order_id INT"))
    after = integrity.orphan_report(lambda n: left if n == "orders" else load(n), tables)
    assert ("order_item", "order_id", "orders", "100", 52) in rows(after)


def test_dangling_rows_are_not_shuffled_for_few_missing_keys(spark):
    load, tables = shop(spark, **DATA)
    plan = integrity.orphan_rows(load, "order_item", tables)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
