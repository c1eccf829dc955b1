"""Bulk CSV export and restore (A4-A8) and the export run log.

Dialect (PostgreSQL ``COPY ... WITH CSV HEADER``): header row, ``"`` as
quote and as escape (doubled quotes), embedded newlines inside quotes, null
as an unquoted empty field, the empty string as ``""``, booleans ``t``/``f``
or ``true``/``false``.  Restore is positional, like ``COPY`` into a table
shaped like the target: the header is skipped, not matched by name.

Each table is written by one distributed job as a directory of part files;
nothing passes through the driver.  New table versions always go to a fresh
directory (a Parquet path cannot be overwritten while it is being read).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TABLE_ORDER, spec
from ..functions.scalars import ts_text
from ..operators.changes import upsert
from ..session import is_absent_path_error
from .store import write_version

# CSV dialect of the export files.  Text is kept as it is, with
# the white space at its edges.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# Rows per export file: a quoted field may hold line ends, so a file is read
# by one task.
MAX_RECORDS_PER_FILE = 1_000_000


def _null_marker() -> str:
    """On read an unquoted empty field is null and a quoted "" the empty
    string; Spark keeps the two apart only if the null text is something
    else.  The marker is drawn for each read, so no text written before can
    equal it."""
    return f"null-{uuid.uuid4().hex}"


def export_projection(df: DataFrame, table: str) -> DataFrame:
    """A4 + G1: the table's columns in export order, timestamps rendered as
    ``yyyy-MM-dd HH:mm:ss`` (fractions dropped)."""
    s = spec(table)
    cols = []
    for c, dtype in s.columns:
        src = df.schema[c].dataType if c in df.columns else dtype
        if isinstance(src, (T.TimestampType, T.TimestampNTZType)):
            cols.append(ts_text(c).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def export_csv(df: DataFrame, table: str, path: str, compression: str = "none") -> str:
    """A4: write the export projection of ``df`` as CSV under ``path``;
    ``read_export_csv`` reads any ``compression`` Spark writes."""
    export_projection(df, table).write.mode("errorifexists").options(
        **CSV_OPTIONS, maxRecordsPerFile=MAX_RECORDS_PER_FILE, compression=compression
    ).csv(path)
    return path


def read_export_csv(spark: SparkSession, path: str, table: str, target_schema: T.StructType | None = None) -> DataFrame:
    """Read an export directory into the target's shape.

    Fields are read as text by position and cast to the target's types
    (``target_schema`` or the catalog schema); ``t``/``f`` cast to booleans
    and the timestamp text to timestamps.  A wrong field count fails.
    """
    s = spec(table)
    schema = s.schema
    if target_schema is not None:
        # the file's order is the catalog's, whatever order the target has
        schema = T.StructType([target_schema[c] for c in s.column_names])
    names = [f.name for f in schema.fields]
    text_schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    raw = (
        spark.read.schema(text_schema)
        .options(**CSV_OPTIONS)
        .option("nullValue", _null_marker())
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def content_digest(df: DataFrame, table: str) -> DataFrame:
    """One row ``(n, digest)``: the number of rows and an order-free digest of
    the table's content in its export form.

    A row's text is, column after column, ``<bytes>:<text>`` or ``n`` for a
    null, so neither a moved border nor a null for an empty text goes unseen;
    numbers with a fraction are taken to the cent.  The digest is the sum of
    the first 48 bits of the rows' MD5 - repeated rows count, and one partial
    sum per task is all that is shuffled."""
    parts = []
    for f in export_projection(df, table).schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("decimal(18,2)")
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    row = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 12), 16, 10).cast("decimal(38,0)")
    return export_projection(df, table).select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")
    )


def restore_table(target: DataFrame, staged: DataFrame, table: str, key: Sequence[str] | None = None) -> DataFrame:
    """Staged upsert on the table key, or on ``key`` where loaded data
    repeat the table's; ``delivery_details.country`` keeps the target's value
    on conflict."""
    s = spec(table)
    return upsert(target, staged, list(key or s.key), keep_on_conflict=list(s.keep_on_conflict))


def _report(spark: SparkSession, rows: list[tuple[str, bool, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "table STRING, ok BOOLEAN, error STRING")


def export_all(
    spark: SparkSession, load: Callable[[str], DataFrame], out_root: str, tables=TABLE_ORDER, compression: str = "none"
) -> DataFrame:
    """A5: export every table to ``out_root/<table>``; a failing table is
    reported and the others continue.  The loop runs over table names on the
    driver; each table is one distributed write."""
    rows = []
    for t in tables:
        try:
            export_csv(load(t), t, os.path.join(out_root, t), compression)
            rows.append((t, True, None))
        except Exception as e:  # noqa: BLE001 - reported per table
            rows.append((t, False, f"{type(e).__name__}: {e}"))
    return _report(spark, rows)


def _path_exists(spark: SparkSession, path: str) -> bool:
    # resolving a file source lists the path without running a job
    try:
        spark.read.format("text").load(path).schema
        return True
    except Exception as e:  # noqa: BLE001
        if is_absent_path_error(e):  # a missing path fails analysis
            return False
        raise


def restore_all(
    spark: SparkSession,
    load: Callable[[str], DataFrame],
    in_root: str,
    out_root: str,
    tables=TABLE_ORDER,
    keys: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Restore every table from ``in_root/<table>`` into the current
    version given by ``load`` and write the result as the next version in the
    table store at ``out_root`` (``store.read_current`` reads it).  ``keys``
    names other key columns for tables whose key the loaded data repeat.
    Errors are collected per table; a missing input root raises."""
    if not _path_exists(spark, in_root):
        raise FileNotFoundError(f"backup folder not found: {in_root}")
    rows = []
    for t in tables:
        try:
            current = load(t)
            staged = read_export_csv(spark, os.path.join(in_root, t), t, current.schema)
            write_version(restore_table(current, staged, t, (keys or {}).get(t)), out_root, t)
            rows.append((t, True, None))
        except Exception as e:  # noqa: BLE001 - reported per table
            rows.append((t, False, f"{type(e).__name__}: {e}"))
    return _report(spark, rows)


# --------------------------------------------------------------------------
# Run log
# --------------------------------------------------------------------------
def record_run(spark: SparkSession, log_path: str, run_ts=None) -> None:
    """Append the time of an export run to the log table."""
    ts = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    spark.range(1).select(ts.alias("run_ts")).write.mode("append").parquet(log_path)


def last_run(spark: SparkSession, log_path: str) -> DataFrame:
    """One row with the latest recorded run time; null before the first
    run, when there is no log yet."""
    try:
        log = spark.read.schema("run_ts TIMESTAMP").parquet(log_path)
        log.schema  # noqa: B018 - resolve now
    except Exception as e:  # noqa: BLE001
        if not is_absent_path_error(e):
            raise
        log = spark.createDataFrame([], "run_ts TIMESTAMP")
    return log.agg(F.max("run_ts").alias("last_run"))
