"""Point and id-list lookups (B4-B7, B10, B11) and existence checks.

Ids are semi joined whatever their number: a Python list becomes a local
table (which the planner broadcasts by its known size), a DataFrame of ids
stays one.  One rule holds for both: a null id matches nothing, and ids given
as text are parsed like JS ``parseInt`` when the key is a number.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import norm_login, parse_int


def _ids_frame(df: DataFrame, key: str, ids) -> DataFrame:
    """The ids as a one-column table of the key's type, without nulls."""
    dtype = df.schema[key].dataType
    if isinstance(ids, DataFrame):
        name = key if key in ids.columns else ids.columns[0]
        given, text = ids.select(F.col(name).alias(key)), isinstance(ids.schema[name].dataType, T.StringType)
    else:
        rows = [(None if i is None else str(i),) for i in ids]
        given, text = df.sparkSession.createDataFrame(rows, f"{key} string"), True
    if text and isinstance(dtype, T.IntegralType):
        value = parse_int(key).try_cast(dtype)
    else:
        value = F.col(key).try_cast(dtype)
    return given.select(value.alias(key)).where(F.col(key).isNotNull())


def in_ids(df: DataFrame, key: str, ids) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (``= ANY(int[])``)."""
    return df.join(_ids_frame(df, key, ids), key, "left_semi").select(*df.columns)


def not_in_ids(df: DataFrame, key: str, ids) -> DataFrame:
    """Rows whose ``key`` is not in ``ids`` (null keys are kept: they cannot
    match a delete request; a null id excludes nothing)."""
    return df.join(_ids_frame(df, key, ids), key, "left_anti").select(*df.columns)


def lookup(df: DataFrame, key: str, ids, cols: Iterable[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is one of ``ids``; optional
    projection (e.g. the username-only user lookup)."""
    out = in_ids(df, key, ids)
    return out.select(*cols) if cols else out


def orders_by_status(orders: DataFrame, status: str, user_ids=None) -> DataFrame:
    """Equality on status, optionally for some users."""
    out = orders.where(F.col("status") == status)
    return in_ids(out, "user_id", user_ids) if user_ids is not None else out


def find_login(users: DataFrame, logins: DataFrame, login_col: str = "login") -> DataFrame:
    """Users whose lower-cased e-mail or username equals a login key.

    ``email = k OR username = k`` as one join condition can only be planned
    as a nested-loop join; it is split into two equi semi joins whose union is
    de-duplicated on the user key.
    """
    keys = logins.select(norm_login(F.col(login_col)).alias("_login")).distinct()
    by_email = users.join(keys, norm_login(users["email"]) == keys["_login"], "left_semi")
    by_name = users.join(keys, norm_login(users["username"]) == keys["_login"], "left_semi")
    return by_email.unionByName(by_name).dropDuplicates(["user_id"])


def split_existing(requests: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests whose key exists in target, requests whose key does not)."""
    keys = target.select(key)
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")

