"""CSV scans: every cell as text, plus the file name and a sequence that follows file order."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_READERS = 16


def _reader(spark: SparkSession, multiline: bool):
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}
    return spark.read.options(**options)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files below ``path``, from the listing alone."""
    return sorted(spark.read.text(path).inputFiles())


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with or without rows in it."""
    # the scan's own file column writes local paths with one slash
    names = [(f.replace("file:///", "file:/", 1),) for f in _files(spark, path)]
    return spark.createDataFrame(names, "source_file string")


def _by_header(spark: SparkSession, path: str, multiline: bool) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. Only the first line of each file is read, several at a time."""
    files = _files(spark, path)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = pool.map(lambda f: tuple(_reader(spark, multiline).csv(f).columns), files)
        found: dict[tuple[str, ...], list[str]] = {}
        for file, header in zip(files, headers, strict=True):
            found.setdefault(header, []).append(file)
    return found


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """Raw text columns of ``schema``, each file by its own header.

    A blank cell is an empty string; a column the file does not have is NULL.

    ``seq`` orders files by name and the rows of a file as they stand in it: first by the
    offset of the split, then by position within the split. It needs no shuffle and is the same
    on every read. Cells with line breaks inside quotes need ``multiline``, which reads each
    file in one piece.
    """
    names = [f for f in schema.fieldNames() if f != "transaction_id"]
    blank, absent = F.lit(""), F.lit(None).cast("string")

    def scan(header: tuple[str, ...], files: list[str]) -> DataFrame:
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = _reader(spark, multiline).schema(text).csv(files)
        columns = [
            (F.coalesce(F.col(f"`{n}`"), blank) if n in header else absent).alias(n)
            for n in names
        ]
        return raw.select(
            *columns,
            F.col("_metadata.file_path").alias("source_file"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("offset"),
                F.monotonically_increasing_id().alias("position"),
            ).alias("seq"),
        )

    scans = [scan(h, f) for h, f in _by_header(spark, path, multiline).items()]
    return reduce(DataFrame.unionByName, scans)
