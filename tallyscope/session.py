"""Session helpers: a local session for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Part = TypeVar("Part")
#: With it, Spark deletes the shuffle files of a query when the query ends. Without it they stay
#: until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# folders staged inside the open ``passing`` blocks of a thread, innermost last
_LOCAL = threading.local()


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, because only there do driver and executors share the machine; it goes when
    the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tallyscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def cut(df):
    """Materialise ``df`` in the shared folder and return it with a short lineage."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    with shuffles_dropped(df.sparkSession):
        # a query takes the setting when it is made
        return df.select("*").checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go when it is written."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of written intermediates goes, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is read inside only: its files go at the end."""
    folders: list[str] = []
    _LOCAL.passing = [*getattr(_LOCAL, "passing", []), folders]
    try:
        yield
    finally:
        _LOCAL.passing = _LOCAL.passing[:-1]
        for folder in folders:
            delete(spark, folder)


def _staging_path(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    if getattr(_LOCAL, "passing", []):
        _LOCAL.passing[-1].append(path)
    return path


def staged(df, name: str = "staged", rows_per_file: int = 0):
    """``df`` written once to the shared folder: its sources are read a single time however often
    the rows are read afterwards. Files of ``rows_per_file`` rows at most spread over many tasks
    when they are read, even if few tasks wrote them; no row moves for it."""
    return staged_in_turn(df.sparkSession, [df], lambda rows: rows, name, rows_per_file)


def staged_in_turn(
    spark: SparkSession, parts: Iterable[Part], make: Callable[[Part], DataFrame],
    name: str = "staged", rows_per_file: int = 0, by: tuple[str, ...] = (),
) -> DataFrame:
    """The rows that ``make`` gives for each of ``parts``, in one staged table."""
    return write_in_turn(spark, parts, make, _staging_path(spark, name), rows_per_file, by)


def write_in_turn(
    spark: SparkSession, parts: Iterable[Part], make: Callable[[Part], DataFrame], path: str,
    rows_per_file: int = 0, by: tuple[str, ...] = (),
) -> DataFrame:
    """The rows that ``make`` gives for each of ``parts`` (one at least), written to ``path``.

    One part is made and written after the other, and the shuffle files and what ``make`` staged for
    a part go before the next, so the disk holds them for a single part.
    """
    schema = None
    for part in parts:
        with passing(spark), shuffles_dropped(spark):
            rows = make(part)
            schema = rows.schema
            rows.write.options(maxRecordsPerFile=rows_per_file, compression="zstd").mode(
                "append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)
