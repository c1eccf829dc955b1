"""Per-table data views (B2a-j, B3), the catalog views (B8, B9) and the joins
they use (C1-C4).

All joins are equi joins.  Which physical join runs is left to the planner:
adaptive execution broadcasts a side only when its measured shuffle output is
below the broadcast threshold and otherwise keeps a sort-merge join, splitting
skewed partitions (a hot product or user) across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import spec
from .lookups import in_ids

# Fixed value: text put in place of product_id when an order line's order is
# missing, and the excluded account in the users view.
NO_ORDER_TEXT = "No product found"
ADMIN_USERNAME = "administrator"


def products_with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products joined with their category name (inner)."""
    cats = categories.select("category_id", "category")
    return products.join(cats, "category_id", "inner")


def orders_with_user(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders joined with the ordering user's name (inner)."""
    u = users.select("user_id", "username")
    return orders.join(u, "user_id", "inner")


def order_item_enriched(
    order_item: DataFrame, products: DataFrame, orders: DataFrame, users: DataFrame
) -> DataFrame:
    """C3 + C4: order lines with product name (inner) and ordering username.

    The username is found through the line's order; a line whose order is
    missing is kept and its product_id is replaced by a marker text, a line
    whose order's user is missing gets a null username.  Orders and users are
    joined first (both far smaller than the lines), so the lines are shuffled
    once by order and once by product.
    """
    order_user = orders.select("order_id", "user_id").join(
        users.select("user_id", "username"), "user_id", "left"
    ).select("order_id", F.lit(True).alias("_has_order"), "username")
    lines = order_item.join(products.select("product_id", "name"), "product_id", "inner")
    joined = lines.join(order_user, "order_id", "left")
    product_id = F.when(F.col("_has_order").isNull(), F.lit(NO_ORDER_TEXT)).otherwise(
        F.col("product_id").cast("string")
    )
    return joined.select(
        "order_item_id",
        "order_id",
        product_id.alias("product_id"),
        "name",
        "quantity",
        "price",
        "total",
        "username",
    )


def catalog(products: DataFrame, categories: DataFrame) -> DataFrame:
    """In-stock products with category; disabled products are included."""
    return products_with_category(products.where(F.col("stock") > 0), categories).select(
        "product_id", "name", "description", "price", "stock", "images", "category_id", "category"
    )


def products_in_category(products: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """Products of one category by name (the filter reaches the
    categories scan; products are semi-joined on the matching ids)."""
    cats = categories.where(F.col("category") == category)
    return products_with_category(products, cats)


def singleton(df: DataFrame, key: str = "about_id", value: int = 1) -> DataFrame:
    """A3: the one-row table (``about``) is read by its fixed key, not by an
    arbitrary first row."""
    return df.where(F.col(key) == value)


def table_view(tables, table: str, ids=None) -> DataFrame:
    """The data view of one table; with ``ids`` only those keys.

    ``tables`` is anything with ``table(name) -> DataFrame``.  The users view
    hides the administrator account only in the all-rows form (B2d); the
    keyed form (B3) shows it.  The password column is never shown.
    """
    s = spec(table)
    if table == "orders":
        out = orders_with_user(tables.table("orders"), tables.table("users"))
    elif table == "order_item":
        out = order_item_enriched(
            tables.table("order_item"), tables.table("products"),
            tables.table("orders"), tables.table("users"),
        )
    elif table == "users":
        out = tables.table("users")
        if ids is None:
            out = out.where(F.col("username") != ADMIN_USERNAME)
    elif table == "products":
        out = products_with_category(tables.table("products"), tables.table("categories"))
    else:
        out = tables.table(table)
    out = out.select(*s.view_columns)
    if ids is not None:
        out = in_ids(out, s.key[0], ids)
    return out
