"""Liquidity pooling: a large investment credit with no investment debit in the next 45 days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.columns import is_credit, is_debit, ratio
from tallyscope.operators.base import INVESTMENT, day_cells
from tallyscope.operators.monthly import customer_profile
from tallyscope.operators.quantile import exact_quantile

REINVEST_DAYS = 45
SIZE_FACTOR = 5
LONGEST_GAP = 90
BUCKET = 10_000


def median_amount(txns: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    cells = day_cells(txns).select("customer_id", "amount", "rows")
    return exact_quantile(cells, ["customer_id"], "amount", 0.5, BUCKET, "median_amount", wanted,
                          weight="rows")


def open_maturities(txns: DataFrame) -> DataFrame:
    """Days with a significant investment credit and no investment debit in the window.

    Investment rows are first reduced to one row per customer and day: a day counts when its
    largest credit is significant. The day-range frame then replaces the unequal-range join.
    """
    days = (
        day_cells(txns).where(F.col("merchant_category") == INVESTMENT)
        .groupBy("customer_id", "date")
        .agg(
            F.max(F.when(is_credit(), F.col("amount"))).alias("largest"),
            F.sum(F.when(is_debit(), F.col("rows")).otherwise(0)).alias("reinvested"),
        )
    )
    ahead = (
        Window.partitionBy("customer_id")
        .orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))
        .rangeBetween(1, REINVEST_DAYS)
    )
    candidates = days.withColumn("later", F.coalesce(F.sum("reinvested").over(ahead), F.lit(0)))
    candidates = candidates.where(F.col("largest").isNotNull() & (F.col("later") == 0))
    median = median_amount(txns, wanted=candidates)
    return (
        candidates.join(median, "customer_id")
        .where(F.col("largest") >= F.col("median_amount") * SIZE_FACTOR)
        .select("customer_id", F.col("date").alias("matured"), "largest", "median_amount")
    )


def first_open_maturity(txns: DataFrame) -> DataFrame:
    """The longest gap belongs to the earliest open maturity."""
    return open_maturities(txns).groupBy("customer_id").agg(F.min("matured").alias("matured"))


def pooling_columns() -> dict[str, Column]:
    """Flag and score over a profile row joined with ``first_open_maturity``."""
    flag = F.col("matured").isNotNull()
    gap = F.least(F.datediff("last_date", "matured"), F.lit(LONGEST_GAP))
    return {
        "liquidity_pooling_flag": flag.cast("double"),
        "liquidity_pooling_score": F.when(
            flag, ratio(F.greatest(gap, F.lit(0)) / F.lit(float(LONGEST_GAP)))
        ).otherwise(F.lit(0.0)),
    }


def liquidity_pooling(txns: DataFrame) -> DataFrame:
    columns = [value.alias(name) for name, value in pooling_columns().items()]
    return (
        customer_profile(txns)
        .join(first_open_maturity(txns), "customer_id", "left")
        .select("customer_id", *columns)
    )
