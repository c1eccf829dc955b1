import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from shopframe import catalog
from shopframe.functions import scalars as S


def test_spec_guard():
    assert catalog.spec("orders").key == ("order_id",)
    with pytest.raises(ValueError):
        catalog.spec("orders; drop table x")
    with pytest.raises(KeyError):
        catalog.spec("no_such_table")


def test_view_columns_listing():
    assert catalog.view_columns("users")[-1] == "password"  # listing shows it
    assert "password" not in catalog.TABLES["users"].view_columns  # data view never does
    assert catalog.view_columns("nope") == []
    assert catalog.view_columns("slide_show") == ["slide_show_id", "title", "description", "image"]


def test_view_columns_frame(spark):
    df = catalog.view_columns_frame(spark)
    got = rows(df.where("table = 'categories'"), "pos", "column")
    assert got == [(0, "category_id"), (1, "category"), (2, "is_disabled")]


def test_export_order_is_physical_order():
    assert catalog.TABLES["slide_show"].column_names[-1] == "slide_show_id"
    assert catalog.TABLES["order_item"].column_names[0] == "product_id"


def test_parse_int_and_float(spark):
    df = spark.createDataFrame([("12abc",), ("abc",), (" -7",), (None,), ("3.9x",)], "s STRING")
    got = [tuple(r) for r in df.select(S.parse_int("s"), S.parse_float("s", T.DoubleType())).collect()]
    assert got == [(12, 12.0), (None, None), (-7, -7.0), (None, None), (3, 3.9)]


def test_falsy_fallback_per_type(spark):
    schema = "n_new INT, n_old INT, d_new DOUBLE, d_old DOUBLE, s_new STRING, s_old STRING, b_new BOOLEAN, b_old BOOLEAN"
    df = spark.createDataFrame(
        [
            (0, 5, float("nan"), 1.5, "", "old", False, True),
            (None, 5, None, 1.5, None, "old", None, True),
            (7, 5, 2.5, 1.5, "0", "old", True, False),
        ],
        schema,
    )
    out = df.select(
        S.falsy_or("n_new", "n_old", T.IntegerType()).alias("n"),
        S.falsy_or("d_new", "d_old", T.DoubleType()).alias("d"),
        S.falsy_or("s_new", "s_old", T.StringType()).alias("s"),
        S.falsy_or("b_new", "b_old", T.BooleanType()).alias("b"),
    ).collect()
    assert [tuple(r) for r in out] == [(5, 1.5, "old", True), (5, 1.5, "old", True), (7, 2.5, "0", True)]


def test_presence_and_default(spark):
    df = spark.createDataFrame([(None, True, "x"), ("y", False, "x")], "new STRING, has BOOLEAN, old STRING")
    got = [r[0] for r in df.select(S.present_or("new", "has", "old")).collect()]
    assert got == [None, "x"]
    b = spark.createDataFrame([(None,), (True,)], "b BOOLEAN")
    assert [r[0] for r in b.select(S.default_false("b")).collect()] == [False, True]


def test_line_total_and_texts(spark):
    df = spark.createDataFrame(
        [(3, "19.99", dt.datetime(1998, 3, 4, 5, 6, 7, 891000))], "q INT, p STRING, ts TIMESTAMP"
    )
    r = df.select(
        S.line_total("q", F.col("p").cast("decimal(18,2)")).alias("t"),
        S.ts_text("ts").alias("txt"),
        S.month_name("ts").alias("m"),
        S.notice_body(F.lit(42)).alias("body"),
    ).first()
    assert float(r.t) == pytest.approx(59.97)
    assert r.txt == "1998-03-04 05:06:07"
    assert r.m == "March"
    assert "order number 42 awaiting" in r.body
