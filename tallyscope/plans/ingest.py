"""Files to tables: check, split, de-duplicate, write and log.

Checked rows are staged first, so a file is parsed once per load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.columns import month_index
from tallyscope.operators import ingest as op
from tallyscope.schemas import (
    CUSTOMERS,
    INGESTION_LOG,
    LABELS,
    STORED_TRANSACTIONS,
    TRANSACTIONS,
)
from tallyscope.session import staged
from tallyscope.sources import tables
from tallyscope.sources.csv_files import read_csv, source_files


def _log(checked: DataFrame, root: str, path: str) -> None:
    files = source_files(checked.sparkSession, path)
    tables.append(op.ingestion_log(checked, files=files), root, "ingestion_log", INGESTION_LOG)


def ingest_customers(spark: SparkSession, root: str, path: str, multiline: bool = False) -> None:
    """Last row of a customer wins, within the file and over the stored table."""
    checked = staged(op.check_customers(read_csv(spark, path, CUSTOMERS, multiline)))
    tables.upsert(op.accepted(checked), ["customer_id"], root, "customers", CUSTOMERS)
    _log(checked, root, path)


def ingest_transactions(
    spark: SparkSession, root: str, path: str, multiline: bool = False
) -> None:
    """Stored transactions never change; only unseen content ids are appended.

    The date is part of the content id, so an id can only be stored in its own month.
    """
    checked = staged(op.check_transactions(read_csv(spark, path, TRANSACTIONS, multiline)))
    new = op.accepted(checked).withColumn("month_idx", month_index(F.col("date")))
    stored = tables.read(spark, root, "transactions", STORED_TRANSACTIONS)
    unseen = op.first_wins(new, ["month_idx", "transaction_id"], stored)
    tables.append_transactions(unseen, root)
    _log(checked, root, path)


def ingest_labels(
    spark: SparkSession, root: str, path: str, products: list[str] | None = None,
    multiline: bool = False,
) -> None:
    """Last label of a customer and product wins."""
    checked = staged(op.check_labels(read_csv(spark, path, LABELS, multiline), products))
    tables.upsert(op.accepted(checked), ["customer_id", "product"], root, "labels", LABELS)
    _log(checked, root, path)


def ingest_all(
    spark: SparkSession, root: str, customers: str, transactions: str, labels: str | None = None
) -> None:
    ingest_customers(spark, root, customers)
    ingest_transactions(spark, root, transactions)
    if labels is not None:
        ingest_labels(spark, root, labels)
