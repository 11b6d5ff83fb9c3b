"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the documents: a run without space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and characters that one Python step holds at once; they bound memory, not results.
BATCH_ROWS = 1000
BATCH_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to ``BATCH_ROWS`` and letting
    Python workers look for this package where the driver found it."""
    root, environment = str(Path(__file__).parents[2]), df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of ``column``; no row is split."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield batch.slice(start)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the rows that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns that a step adds on its way."""
    prefix = "_"
    while any(name.startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix
