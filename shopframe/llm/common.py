"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root, scratch_path

#: A word is a run of characters other than the blank and ASCII 9-13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Text handed to a Python worker at once.  Long texts make batches short in
#: rows, so that a worker's memory does not follow the longest documents.
BATCH_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    they can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver's own copy: Spark's file server hands it to the executors
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="shopframe-code-")), "shopframe_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in either case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Before Python work: the workers get this package, and the session's
    Arrow batches are bounded by bytes as well as by rows."""
    _ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per input row.  ``make()`` runs once per task and gives
    the function of a row's values, so that it may load a model first."""
    bounded_batches(df.sparkSession)
    names = [x.strip().split()[0] for x in schema.split(",")]
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = list(zip(*(row(*values) for values in zip(*cols)))) if cols and cols[0] else []
            if out:
                arrays = [pa.array(list(v), type=target.field(n).type) for n, v in zip(names, out)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(","))])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table into the shared folder and read back: cuts
    the lineage with files that outlive any executor."""
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
