"""Scalar column functions (G1-G14).  All are built-in Spark expressions, so
they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text formats used by the shop.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"  # to_char(ts, 'YYYY-MM-DD HH24:MI:SS')
MONTH_NAME_FORMAT = "MMMM"  # to_char(ts, 'Month'), trimmed
MONEY = T.DecimalType(18, 2)
# Notice sent to the seller when an order waits for approval.
NOTICE_SUBJECT = "New Order Placed"
NOTICE_BODY = "You have a new order, order number %s awaiting your verification"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_text(c) -> Column:
    """G1: timestamp rendered to the second (fraction dropped)."""
    return F.date_format(_c(c), TS_TEXT_FORMAT)


def month_name(c) -> Column:
    """G2 + G6: full English month name without padding."""
    return F.trim(F.date_format(_c(c), MONTH_NAME_FORMAT))


def as_of_ts(as_of=None) -> Column:
    """The run's 'now' as a column; a fixed value keeps jobs replayable."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp")


def norm_login(c) -> Column:
    """Lower-case normalisation of usernames, e-mails and login keys."""
    return F.lower(_c(c))


def parse_int(c) -> Column:
    """Leading-integer parse like JS ``parseInt``, as BIGINT; no digits,
    or more than a BIGINT holds, gives null."""
    digits = F.regexp_extract(_c(c).cast("string"), r"^\s*([+-]?[0-9]+)", 1)
    return _try_cast(digits, "bigint")


def parse_float(c, to: T.DataType = MONEY) -> Column:
    """Leading-number parse like JS ``parseFloat``; no number gives null."""
    num = F.regexp_extract(
        _c(c).cast("string"), r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1
    )
    return _try_cast(num, to.simpleString())


def _try_cast(c: Column, type_name: str) -> Column:
    # An empty match means "no number"; try_cast turns it into null without
    # raising under ANSI mode.
    return F.when(c == "", F.lit(None)).otherwise(c).try_cast(type_name)


def line_total(quantity="quantity", price="price") -> Column:
    """A line's total is always recomputed as quantity x price."""
    return (_c(quantity).cast(MONEY) * _c(price).cast(MONEY)).cast(MONEY)


def falsy(c, dtype: T.DataType) -> Column:
    """JS falsiness of a value of the given Spark type: null, false, 0, NaN
    and '' are falsy; anything else (including the text '0') is truthy."""
    col = _c(c)
    if isinstance(dtype, T.BooleanType):
        return col.isNull() | ~col
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | (col == 0) | F.isnan(col)
    if isinstance(dtype, T.NumericType):
        return col.isNull() | (col == 0)
    if isinstance(dtype, T.StringType):
        return col.isNull() | (col == "")
    return col.isNull()


def update_applies(new, dtype: T.DataType | None, mode: str, present=None) -> Column:
    """Whether a change's value replaces the old one.

    falsy     G11, ``new || old``: falsy values keep the old one
    null_only ``new ?? old``: only null keeps the old one
    presence  G12, ``new !== undefined ? new : old``: the change's presence
              flag decides, so an explicit null overwrites
    """
    if mode == "falsy":
        return ~falsy(new, dtype)
    if mode == "null_only":
        return _c(new).isNotNull()
    if mode == "presence":
        return F.coalesce(_c(present), F.lit(False))
    raise ValueError(f"unknown update mode {mode!r}")


def falsy_or(new, old, dtype: T.DataType) -> Column:
    """G11 for one value: ``new || old``."""
    return F.when(update_applies(new, dtype, "falsy"), _c(new)).otherwise(_c(old))


def present_or(new, present, old) -> Column:
    """G12 for one value: ``new !== undefined ? new : old``."""
    return F.when(update_applies(new, None, "presence", present), _c(new)).otherwise(_c(old))


def default_false(c) -> Column:
    """``is_disabled || false``."""
    return F.coalesce(_c(c), F.lit(False))


def notice_body(order_id) -> Column:
    """Approval notice text for an order id."""
    return F.format_string(NOTICE_BODY, _c(order_id).cast("string"))
