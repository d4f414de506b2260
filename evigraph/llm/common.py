"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.shared import shared_dir

#: ASCII white space, as a regular expression class body (fixed value of the word definition).
SPACE_CLASS = r"\x20\x09-\x0D"


#: The setting that removes a query's shuffle files when it ends (fixed value of Spark).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the written query go with its end: what follows reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no frame still to be computed reads."""
    for t in tables:
        spark = t.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_array(text):
    """Words: maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def grouped(batches, keys: list[str]):
    """Yield one pyarrow table for each run of equal keys in a stream of batches sorted by those keys."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, key in enumerate(rows):
            if last is not None and key != last:
                if i > start:
                    carry.append(batch.slice(start, i - start))
                yield last, pa.Table.from_batches(carry)
                carry, start = [], i
            last = key
        if start < batch.num_rows:
            carry.append(batch.slice(start))
    if carry:
        yield last, pa.Table.from_batches(carry)


_STATE: list = [None, None]


def worker_state(key: tuple, make):
    """What an operator keeps between the tasks of a Python worker; one operator's at a time, so memory doesn't add up."""
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        give_back()
        _STATE[:] = [key, make()]
    return _STATE[1]


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batches, rows: int = 1000):
    """The batches in parts of limited size, so that what is unpacked at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
