"""Table versions in Parquet folders, and reading the shop's tables over JDBC.

Versions: every job writes the next version of a table to a fresh folder
``<root>/<table>/<version>`` and only after the write succeeded appends a
pointer row ``(table, version, path, written_at)`` to ``<root>/_versions``.
Readers follow the newest pointer, so a failed or re-run job never exposes a
half-written table, and the version being read is never overwritten.

JDBC: the shop keeps its tables in PostgreSQL; ``read_jdbc_table`` reads one
with parallel range partitions on the integer key and conforms it to the
catalog types.  It needs the PostgreSQL JDBC driver on the cluster's class
path; it is not exercised by the tests here (no database is started).
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import spec
from ..session import is_absent_path_error

VERSIONS = "_versions"
VERSIONS_SCHEMA = "table STRING, version STRING, path STRING, written_at TIMESTAMP"


def write_version(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version of ``table`` and point readers at it."""
    spec(table)
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    path = os.path.join(root, table, version)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    spark = df.sparkSession
    spark.createDataFrame(
        [(table, version, path, datetime.now(timezone.utc).replace(tzinfo=None))], VERSIONS_SCHEMA
    ).write.mode("append").parquet(os.path.join(root, VERSIONS))
    return path


def current_path(spark: SparkSession, root: str, table: str) -> str | None:
    """Path of the newest version of ``table`` (None when there is none);
    reads the small pointer table only."""
    try:
        ptr = spark.read.schema(VERSIONS_SCHEMA).parquet(os.path.join(root, VERSIONS))
        row = (
            ptr.where(F.col("table") == table)
            .agg(F.max_by("path", F.struct("written_at", "version")).alias("p"))
            .first()
        )
    except Exception as e:  # noqa: BLE001
        if is_absent_path_error(e):  # no pointer table yet
            return None
        raise
    return row["p"] if row else None


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    path = current_path(spark, root, table)
    if path is None:
        raise FileNotFoundError(f"no version of {table!r} under {root}")
    return spark.read.parquet(path)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    num_partitions: int = 64,
) -> DataFrame:
    """Read one shop table over JDBC in ``num_partitions`` parallel key
    ranges and cast it to the catalog types (columns in catalog order)."""
    s = spec(table)
    key = s.key[0]
    bounds = spark.read.jdbc(
        url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM public.{table}) b", properties=properties
    ).first()
    lo, hi = (bounds["lo"] or 0), (bounds["hi"] or 0)
    df = spark.read.jdbc(
        url,
        f"public.{table}",
        column=key,
        lowerBound=int(lo),
        upperBound=int(hi) + 1,
        numPartitions=max(1, num_partitions),
        properties=properties,
    )
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in s.columns])
