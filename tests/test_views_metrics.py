import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from shopframe.operators import lookups, metrics, views


def _shop(spark):
    users = spark.createDataFrame(
        [(1, "administrator", "Admin@Shop.com", "x", False, "admin"),
         (2, "Alice", "Alice@Mail.com", "x", False, "customer"),
         (3, None, "nobody@mail.com", "x", True, "customer")],
        "user_id INT, username STRING, email STRING, password STRING, is_disabled BOOLEAN, user_type STRING",
    )
    orders = spark.createDataFrame(
        [(10, 2, 5.0, "paid", dt.datetime(1998, 1, 5), "d"),
         (11, 9, 7.0, "draft", dt.datetime(1998, 2, 5), "d")],  # user 9 missing
        "order_id INT, user_id INT, total DOUBLE, status STRING, created_at TIMESTAMP, description STRING",
    )
    products = spark.createDataFrame(
        [(100, "bolt", "b", 1.0, 0, None, True, 1), (101, "nut", "n", 2.0, 4, None, False, 2),
         (102, "gear", "g", 3.0, 9, None, False, 7)],  # category 7 missing
        "product_id INT, name STRING, description STRING, price DOUBLE, stock INT, images STRING, "
        "is_disabled BOOLEAN, category_id INT",
    )
    categories = spark.createDataFrame([(1, "Tools", False), (2, "Parts", False)],
                                       "category_id INT, category STRING, is_disabled BOOLEAN")
    items = spark.createDataFrame(
        [("a", 10, 100, 1, "1.00", "1.00"), ("b", 11, 101, 2, "2.00", "4.00"),
         ("c", 12, 101, 1, "2.00", "2.00"),  # order 12 missing
         ("d", 10, 999, 1, "9.00", "9.00")],  # product 999 missing
        "order_item_id STRING, order_id INT, product_id INT, quantity INT, price STRING, total STRING",
    ).withColumn("price", F.col("price").cast("decimal(18,2)")).withColumn("total", F.col("total").cast("decimal(18,2)"))
    return users, orders, products, categories, items


class Tables:
    def __init__(self, **t):
        self.t = t

    def table(self, name):
        return self.t[name]


def test_order_item_view_orphans(spark):
    users, orders, products, categories, items = _shop(spark)
    v = views.order_item_enriched(items, products, orders, users)
    got = {r.order_item_id: (r.product_id, r.username) for r in v.collect()}
    # line of a missing product is dropped by the inner join
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == ("100", "Alice")
    assert got["b"] == ("101", None)  # order exists, its user does not
    assert got["c"] == ("No product found", None)  # order missing


def test_users_view_and_keyed_view(spark):
    users, orders, products, categories, items = _shop(spark)
    t = Tables(users=users, orders=orders, products=products, categories=categories, order_item=items)
    v = views.table_view(t, "users")
    assert [r.user_id for r in v.collect()] == [2]  # admin and null username excluded
    assert "password" not in v.columns
    keyed = views.table_view(t, "users", ids=[1, 3])
    assert sorted(r.user_id for r in keyed.collect()) == [1, 3]


def test_products_views(spark):
    users, orders, products, categories, items = _shop(spark)
    t = Tables(users=users, orders=orders, products=products, categories=categories, order_item=items)
    pv = views.table_view(t, "products")
    assert pv.columns == ["product_id", "name", "description", "price", "stock", "images", "is_disabled", "category"]
    assert sorted(r.product_id for r in pv.collect()) == [100, 101]
    cat = views.catalog(products, categories)
    assert [r.product_id for r in cat.collect()] == [101]  # stock 0 out, disabled kept if stocked
    assert [r.product_id for r in views.products_in_category(products, categories, "Tools").collect()] == [100]
    ov = views.table_view(t, "orders")
    assert rows(ov, "order_id", "username") == [(10, "Alice")]


def test_lookups(spark):
    users, orders, *_ = _shop(spark)
    assert rows(lookups.lookup(users, "user_id", [2], cols=["username"])) == [("Alice",)]
    ids = spark.createDataFrame([(10,), (99,)], "order_id INT")
    assert rows(lookups.in_ids(orders, "order_id", ids), "order_id") == [(10,)]
    assert rows(lookups.not_in_ids(orders, "order_id", ids), "order_id") == [(11,)]
    big = list(range(5000))
    assert lookups.in_ids(orders, "order_id", big).count() == 2
    assert rows(lookups.orders_by_status(orders, "paid", [2]), "order_id") == [(10,)]
    logins = spark.createDataFrame([("alice",), ("alice@mail.com",), ("NOBODY@mail.com",), ("zed",)], "login STRING")
    assert rows(lookups.find_login(users, logins), "user_id") == [(2,), (3,)]
    exist, missing = lookups.split_existing(ids, orders, "order_id")
    assert rows(exist) == [(10,)] and rows(missing) == [(99,)]


def test_monthly_dataset(spark):
    df = spark.createDataFrame(
        [(1, "paid", dt.datetime(1998, 1, 2)), (2, "paid", dt.datetime(1998, 1, 9)),
         (3, "Pending", dt.datetime(1998, 1, 3)), (4, None, dt.datetime(1998, 2, 1)),
         (5, "draft", dt.datetime(1997, 1, 1))],
        "order_id INT, status STRING, created_at TIMESTAMP",
    )
    long_ = rows(metrics.orders_by_month_status(df, 1998), "month", "status", "count")
    assert long_ == [("February", None, 1), ("January", "Pending", 1), ("January", "paid", 2)]
    wide = {r.month: r for r in metrics.monthly_status_dataset(df, 1998, with_other=True).collect()}
    assert (wide["January"].paid, wide["January"].draft, wide["January"].pending_approval) == (2, 0, 0)
    assert wide["January"].other == {"Pending": 1}
    assert wide["February"].other == {"null": 1}
    wide2 = {r.month: r for r in metrics.monthly_status_dataset(df, 1998, extra_statuses=["Pending"]).collect()}
    assert wide2["January"].Pending == 1


def test_subtotals_next_ids_picks(spark):
    users, orders, products, categories, items = _shop(spark)
    sub = dict((r.order_id, r.total) for r in metrics.order_subtotals(items).collect())
    assert sub == {10: 10.0, 11: 4.0, 12: 2.0}
    empty = orders.limit(0)
    assert metrics.next_id(empty, "order_id").first().next_id == 1
    assert metrics.next_id(orders, "order_id").first().next_id == 12
    o = spark.createDataFrame(
        [(1, 7, "draft", dt.datetime(2000, 1, 1)), (2, 7, "draft", dt.datetime(2000, 1, 1)),
         (3, 7, "draft", dt.datetime(1999, 1, 1)), (4, 8, "Pending", dt.datetime(2000, 1, 1))],
        "order_id INT, user_id INT, status STRING, created_at TIMESTAMP",
    )
    assert rows(metrics.latest_order(o, "draft")) == [(7, 2)]  # tie on time: larger id
    assert rows(metrics.first_order(o, "draft")) == [(7, 3)]
    assert rows(metrics.first_order(o, "Pending")) == [(8, 4)]
    dem = metrics.product_demand(items, orders, "paid")
    assert rows(dem) == [(100, 1), (999, 1)]


def test_monthly_dataset_defaults_to_current_year(spark):
    this_year = dt.date.today().year
    df = spark.createDataFrame(
        [(1, "paid", dt.datetime(this_year, 3, 1)), (2, "paid", dt.datetime(1998, 3, 1))],
        "order_id INT, status STRING, created_at TIMESTAMP",
    )
    got = metrics.monthly_status_dataset(df).collect()
    assert [(r.month, r.paid, r.draft) for r in got] == [("March", 1, 0)]


def test_one_rule_for_ids_at_every_size(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k INT")
    for pad in ([], list(range(1000, 3000))):
        assert rows(lookups.in_ids(df, "k", [1, None, *pad])) == [(1,)]
        assert rows(lookups.not_in_ids(df, "k", [1, None, *pad])) == [(2,), (3,), (None,)]
        text = ["2", "3abc", "x", "3000000000", None, *map(str, pad)]
        assert rows(lookups.in_ids(df, "k", text)) == [(2,), (3,)]
        ids = spark.createDataFrame([(i,) for i in text], "k STRING")
        assert rows(lookups.in_ids(df, "k", ids)) == [(2,), (3,)]
        assert rows(lookups.not_in_ids(df, "k", ids)) == [(1,), (None,)]


def test_months_come_sorted_by_name(spark):
    df = spark.createDataFrame(
        [(i, "paid", dt.datetime(1998, m, 1)) for i, m in enumerate([7, 4, 2, 12, 1, 9])], "order_id INT, status STRING, created_at TIMESTAMP"
    ).repartition(4)
    names = ["April", "December", "February", "January", "July", "September"]
    assert [r.month for r in metrics.orders_by_month_status(df, 1998).collect()] == names
    assert [r.month for r in metrics.monthly_status_dataset(df, 1998).collect()] == names
    assert [r.month for r in metrics.monthly_status_dataset(df, 1998, with_other=True).collect()] == names


def test_null_status_and_the_text_null_share_a_key(spark):
    df = spark.createDataFrame([(1, None, dt.datetime(1998, 1, 1)), (2, "null", dt.datetime(1998, 1, 2))], "order_id INT, status STRING, created_at TIMESTAMP")
    assert metrics.monthly_status_dataset(df, 1998, with_other=True).first().other == {"null": 2}
