"""Shop tables derived from the driver's test tables.

The test data has no shop tables, so each shop table is a projection of one
(or a join of a few) test tables; FIXTURES.md section 2 gives the same mapping
as SQL.  Every table is conformed to its catalog column list: columns the test
data cannot provide are typed nulls, ids keep the test data's BIGINT and money
columns stay DOUBLE except order-line money, which is DECIMAL(18,2).

All frames are lazy scans; Catalyst prunes the columns and pushes filters into
the Parquet readers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TABLES
from ..functions.scalars import MONEY

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TEST_TABLES:
        raise KeyError(f"Unknown test table: {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Select the catalog columns in catalog order; absent ones become typed
    nulls of the catalog type."""
    spec = TABLES[table]
    present = set(df.columns)
    cols = []
    for name, dtype in spec.columns:
        if name in present:
            cols.append(F.col(name))
        else:
            if isinstance(dtype, T.TimestampType):
                # the test data's timestamps are TIMESTAMP_NTZ; keep one kind
                dtype = T.TimestampNTZType()
            cols.append(F.lit(None).cast(dtype).alias(name))
    return df.select(*cols)


def _email(custkey) -> F.Column:
    return F.concat(F.lit("User"), custkey.cast("string"), F.lit("@Example.com"))


def _category_id(brand) -> F.Column:
    return F.regexp_replace(brand, "Brand#", "").cast("int")


class ShopTables:
    """Lazy shop tables over one test-data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_test_table(self.spark, self.sf_dir, name)

    # -- shop tables -----------------------------------------------------
    def users(self) -> DataFrame:
        c = self.raw("customer")
        return _conform(
            c.select(
                F.col("c_custkey").alias("user_id"),
                F.when(F.col("c_custkey") == 0, F.lit("administrator"))
                .otherwise(F.col("c_name"))
                .alias("username"),
                _email(F.col("c_custkey")).alias("email"),
                (F.col("c_acctbal") < 0).alias("is_disabled"),
                F.col("c_mktsegment").alias("user_type"),
            ),
            "users",
        )

    def categories(self) -> DataFrame:
        # distinct over the brand column: partial aggregation before the shuffle
        p = self.raw("part")
        return _conform(
            p.select(
                _category_id(F.col("p_brand")).alias("category_id"),
                F.col("p_brand").alias("category"),
                F.lit(False).alias("is_disabled"),
            ).distinct(),
            "categories",
        )

    def products(self) -> DataFrame:
        p = self.raw("part")
        return _conform(
            p.select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("name"),
                F.col("p_type").alias("description"),
                F.col("p_retailprice").alias("price"),
                (F.col("p_size") - 1).alias("stock"),
                (F.col("p_size") > 45).alias("is_disabled"),
                _category_id(F.col("p_brand")).alias("category_id"),
            ),
            "products",
        )

    def orders(self) -> DataFrame:
        o = self.raw("orders")
        status = (
            F.when(F.col("o_orderstatus") == "F", F.lit("paid"))
            .when(F.col("o_orderstatus") == "O", F.lit("draft"))
            .when(F.col("o_orderpriority") == "1-URGENT", F.lit("Pending"))
            .otherwise(F.lit("pending_approval"))
        )
        return _conform(
            o.select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("user_id"),
                F.col("o_totalprice").alias("total"),
                status.alias("status"),
                F.col("o_orderdate").alias("created_at"),
                F.col("o_orderpriority").alias("description"),
            ),
            "orders",
        )

    def order_item(self) -> DataFrame:
        li = self.raw("lineitem")
        line_id = F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        )
        # unit price floored to the cent before the decimal cast, so no
        # half-cent rounding rule is involved
        unit = (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).cast(MONEY)
        return _conform(
            li.select(
                line_id.alias("order_item_id"),
                F.col("l_orderkey").alias("order_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_quantity").cast("int").alias("quantity"),
                unit.alias("price"),
                F.col("l_extendedprice").cast(MONEY).alias("total"),
            ),
            "order_item",
        )

    def delivery_details(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name")
        joined = o.join(c, o.o_custkey == c.c_custkey, "inner").join(
            n, F.col("c_nationkey") == F.col("n_nationkey"), "inner"
        )
        return _conform(
            joined.select(
                F.col("o_orderkey").alias("delivery_id"),
                F.col("o_custkey").alias("user_id"),
                F.col("o_orderkey").alias("order_id"),
                _email(F.col("c_custkey")).alias("email"),
                F.col("n_name").alias("country"),
                F.col("o_orderpriority").alias("status"),
            ),
            "delivery_details",
        )

    def newsletter(self) -> DataFrame:
        # subscribers: every customer
        c = self.raw("customer")
        return _conform(
            c.select(
                F.col("c_custkey").alias("newsletter_id"),
                F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                F.lit(False).alias("is_disabled"),
            ),
            "newsletter",
        )

    def customer_testimonial(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "source", "text")
        lab = self.raw("labels").select("doc_id", "quality")
        return _conform(
            d.join(lab, "doc_id", "left").select(
                F.col("doc_id").alias("customer_testimonial_id"),
                F.col("source").alias("name"),
                F.col("text").alias("comment"),
                F.col("quality").alias("rating"),
            ),
            "customer_testimonial",
        )

    def slide_show(self) -> DataFrame:
        pg = self.raw("pages")
        return _conform(
            pg.select(
                F.col("page_id").alias("slide_show_id"),
                F.col("url").alias("title"),
                F.col("html").alias("description"),
            ),
            "slide_show",
        )

    def table(self, name: str) -> DataFrame:
        if name == "about":
            raise KeyError("the test data has no 'about' rows")
        return getattr(self, name)()

    # -- request streams derived from the click-stream ------------------
    def events(self) -> DataFrame:
        return self.raw("events")
