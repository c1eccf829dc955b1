"""Referential checks over the shop's foreign keys (2.K).

A restore loads the tables in an order that ignores foreign keys, and deletes
do not cascade, so rows may name a parent that is not there.  All relations
of ``catalog.FOREIGN_KEYS`` are checked in one job:

* each child table is scanned once and gives one (relation, key) per foreign
  key; references are counted per key before they are shuffled, so a missing
  key that a third of all rows name is one row per task;
* the counted references meet the parents' keys in one anti join on (parent,
  key).  Nothing is broadcast by force and no key is collected.

A null foreign key refers to nothing: it is no orphan, and is counted apart.
Keys are compared as text of the parent key's type, so an INT column may
refer to a BIGINT key.  A relation whose tables are not given is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import FOREIGN_KEYS, spec
from ..session import scratch_path

Load = Callable[[str], DataFrame]


def _relations(tables) -> list[tuple[str, str, str]]:
    for t in tables:
        spec(t)
    return [r for r in FOREIGN_KEYS if r[0] in tables and r[2] in tables]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parents(load: Load, relations) -> DataFrame:
    """``parent, key`` of every table that is referred to."""
    names = list(dict.fromkeys(parent for _, _, parent in relations))
    return _union([
        load(n).select(F.lit(n).alias("parent"), F.col(spec(n).key[0]).cast("string").alias("key")) for n in names
    ]).where("key is not null")


def _references(load: Load, relations) -> DataFrame:
    """``child, column, parent, key, n``: how many rows refer to each key; a
    null key stands for rows that refer to nothing."""
    key_types = {n: load(n).schema[spec(n).key[0]].dataType for _, _, n in relations}
    parts = []
    for child in dict.fromkeys(c for c, _, _ in relations):
        # one scan of the child for all its relations
        named = [
            F.struct(
                F.lit(column).alias("column"), F.lit(parent).alias("parent"),
                F.col(column).cast(key_types[parent]).cast("string").alias("key"),
            )
            for c, column, parent in relations if c == child
        ]
        parts.append(load(child).select(F.lit(child).alias("child"), F.explode(F.array(*named)).alias("r")).select("child", "r.*"))
    return _union(parts).groupBy("child", "column", "parent", "key").agg(F.count(F.lit(1)).alias("n"))


def orphan_report(load: Load, tables) -> DataFrame:
    """One row ``(child, column, parent, missing_key, n)`` per relation and
    key that ``n`` rows name and the parent table lacks.  ``load`` gives a
    table by its name."""
    relations = _relations(tables)
    if not relations:
        raise ValueError("no foreign key lies between the given tables")
    named = _references(load, relations).where("key is not null")
    return named.join(_parents(load, relations), ["parent", "key"], "left_anti").select(
        "child", "column", "parent", F.col("key").alias("missing_key"), "n"
    )


def orphan_summary(load: Load, tables) -> DataFrame:
    """One row per relation with references: rows that refer, rows that refer
    to nothing (null), different keys, missing keys and orphaned rows."""
    relations = _relations(tables)
    if not relations:
        raise ValueError("no foreign key lies between the given tables")
    there = _parents(load, relations).distinct().withColumn("_there", F.lit(True))
    met = _references(load, relations).join(there, ["parent", "key"], "left")
    named, missing = F.col("key").isNotNull(), F.col("key").isNotNull() & F.col("_there").isNull()

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return met.groupBy("child", "column", "parent").agg(
        rows(named).alias("referring"), rows(~named).alias("null_refs"), F.count_if(named).alias("keys"),
        F.count_if(missing).alias("missing_keys"), rows(missing).alias("orphans"),
    )


def _missing_keys(load: Load, table: str, column: str, parent: str) -> DataFrame:
    """``key``, once each: the keys that ``column`` of ``table`` names and
    ``parent`` lacks.  They are written to the checkpoint folder, so the
    planner knows how few they are before it moves a row of the table."""
    there = load(parent)
    name = spec(parent).key[0]
    named = load(table).select(_key(F.col(column), there.schema[name].dataType).alias("key")).where("key is not null").distinct()
    missing = named.join(there.select(_key(F.col(name), there.schema[name].dataType).alias("key")), "key", "left_anti")
    path = scratch_path(there.sparkSession, "missing-keys")
    missing.write.parquet(path)
    return there.sparkSession.read.schema(missing.schema).parquet(path)


def _key(column: Column, key_type: T.DataType) -> Column:
    """A key as the parent's type, and as text if that is no whole number."""
    typed = column.cast(key_type)
    return typed if isinstance(key_type, T.IntegralType) else typed.cast("string")


def orphan_rows(load: Load, table: str, tables) -> DataFrame:
    """The rows of ``table`` that name a missing parent, with ``missing``, the
    names of the foreign key columns that do.  The rows meet the missing keys
    only (one row per key), by plain joins that adaptive execution may split;
    while these keys are few, the rows are not shuffled at all."""
    relations = [r for r in _relations(tables) if r[0] == table]
    out = load(table)
    columns = out.columns
    if not relations:
        return out.limit(0).withColumn("missing", F.array().cast("array<string>"))
    marks = []
    for i, (_, column, parent) in enumerate(relations):
        key_type = load(parent).schema[spec(parent).key[0]].dataType
        keys = _missing_keys(load, table, column, parent).select(F.col("key").alias(f"_k{i}"))
        marks.append(F.when(F.col(f"_k{i}").isNotNull(), F.lit(column)))
        out = out.join(keys, _key(out[column], key_type) == F.col(f"_k{i}"), "left")
    return out.withColumn("missing", F.array_compact(F.array(*marks))).where(F.size("missing") > 0).select(*columns, "missing")
