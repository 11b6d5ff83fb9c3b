"""Debt-behaviour features: recurring instalment series, punctuality, debt-to-income, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import (
    completeness,
    in_series,
    is_debit,
    middle,
    ratio,
    safe_divide,
    spread_of,
    trend_over_mean,
)
from tallyscope.operators.base import activity_cells
from tallyscope.operators.monthly import customer_profile, tail

MIN_PAYMENTS = 3
MAX_AMOUNT_CV = 0.10


def _series_cells(txns: DataFrame) -> DataFrame:
    return activity_cells(txns).where(is_debit() & in_series())


def recurring_series(txns: DataFrame) -> DataFrame:
    """One row per recurring debit series with its amount spread.

    Only sums are kept, so one very long series is combined map-side before it meets in one place.
    """
    series = _series_cells(txns).groupBy("customer_id", "recurring_group_id").agg(
        F.sum("rows").cast("bigint").alias("payments"),
        F.sum("amount").cast("decimal(38,2)").alias("paid"),
        F.sum("squares").cast("decimal(38,4)").alias("squares"),
        F.sum("on_time").cast("bigint").alias("on_time"),
    )
    n = F.col("payments")
    mean = F.col("paid").cast("double") / n
    # exact decimals up to the difference, so that the order of partial sums can't move it
    spread = spread_of(n, F.col("paid"), F.col("squares"))
    variance = F.try_divide(spread, (n * (n - 1)).cast("double"))
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return series.select(
        "customer_id", "recurring_group_id", "payments", "on_time",
        mean.alias("mean_amount"),
        safe_divide(deviation, mean, otherwise=1.0).alias("amount_cv"),
    )


def emi_series(txns: DataFrame) -> DataFrame:
    """Series that look like instalments: enough payments of a steady amount."""
    return recurring_series(txns).where(
        (F.col("payments") >= MIN_PAYMENTS) & (F.col("amount_cv") < MAX_AMOUNT_CV)
    )


def emi_totals(txns: DataFrame) -> DataFrame:
    """Per customer: number of instalment series, payments, on-time payments, monthly sums.

    Few series are instalments, so only their cells are added up by (customer, month); the array
    has one entry per calendar month. A null customer has no totals.
    """
    emi = emi_series(txns)
    counts = emi.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("emi_count"),
        F.sum("payments").alias("emi_payments"),
        F.sum("on_time").alias("emi_on_time"),
    )
    months = (
        _series_cells(txns)
        .join(emi.select("customer_id", "recurring_group_id"), ["customer_id", "recurring_group_id"])
        .groupBy("customer_id", "month_idx").agg(F.sum("amount").cast("decimal(38,2)").alias("paid"))
        .groupBy("customer_id")
        .agg(F.collect_list(F.struct("month_idx", "paid")).alias("emi_months"))
    )
    return counts.join(months, "customer_id")


def debt_columns() -> dict[str, Column]:
    """Debt features over a profile row joined with ``emi_totals``."""
    k = F.least(F.lit(3), F.col("active_months"))
    dues = F.coalesce(middle(tail("paid", k, "emi_months")), F.lit(0))
    dti = safe_divide(dues, middle(tail("credits", k)))
    span = F.col("debits_last") - F.col("debits_first") + 1
    trend = trend_over_mean(
        span, F.col("debits_first"), F.col("debits_sum"), F.col("debits_moment")
    )
    return {
        "emi_punctuality_score": ratio(F.col("emi_on_time") / F.col("emi_payments")),
        "current_dti": ratio(dti),
        "debt_trend_direction": F.when(
            F.col("debits_first").isNotNull() & (F.col("active_months") >= 3),
            F.when(span >= 3, ratio(trend)).otherwise(F.lit(0.0)),
        ),
        "num_active_emis": F.coalesce("emi_count", F.lit(0)).cast("double"),
    }


def debt_features(txns: DataFrame) -> DataFrame:
    columns = [value.alias(name) for name, value in debt_columns().items()]
    return (
        customer_profile(txns)
        .join(emi_totals(txns), "customer_id", "left")
        .select("customer_id", *columns,
                completeness(F.col("active_months")).alias("completeness"))
    )
