"""Income stability features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import (
    completeness,
    is_credit,
    middle,
    money,
    ratio,
    safe_divide,
    trend_over_mean,
)
from tallyscope.operators.base import activity_cells
from tallyscope.operators.monthly import customer_profile


def income_sources(txns: DataFrame) -> DataFrame:
    """Distinct credit categories per customer.

    A single distinct count is planned as two partial aggregations, the first of them by
    (customer, category), so a customer with many rows stays spread out.
    """
    return (
        activity_cells(txns).where(is_credit())
        .groupBy("customer_id")
        .agg(F.count_distinct("category").alias("num_income_sources"))
    )


def income_columns() -> dict[str, Column]:
    """Income features over a profile row that carries ``num_income_sources``."""
    growth = trend_over_mean(
        F.col("span"), F.col("first_idx"), F.col("credits_sum"), F.col("credits_moment")
    )
    variance = F.when(F.col("salary_months") == 1, F.lit(0.0)).otherwise(
        safe_divide(F.col("salary_std"), F.col("salary_mean"))
    )
    tenure = F.datediff("last_date", "first_salary") / F.lit(30.0)
    has_credit = F.col("credits_first").isNotNull()
    return {
        "salary_variance_12m": F.when(F.col("salary_months") > 0, ratio(variance)),
        "income_growth_pct": F.when(has_credit & (F.col("span") >= 3), ratio(growth * 100)),
        "num_income_sources": F.coalesce("num_income_sources", F.lit(0)).cast("double"),
        "income_source_tenure_months": F.coalesce(F.round(tenure, 1), F.lit(0.0)),
        "salary_amount_median": F.coalesce(money(middle(F.col("salaries"))), F.lit(0.0)),
    }


def income_features(txns: DataFrame) -> DataFrame:
    profile = customer_profile(txns).join(income_sources(txns), "customer_id", "left")
    columns = [value.alias(name) for name, value in income_columns().items()]
    return profile.select(
        "customer_id", *columns, completeness(F.col("active_months")).alias("completeness")
    )


def salary_stats(txns: DataFrame) -> DataFrame:
    """Coefficient of variation and median of the monthly salary sums."""
    columns = income_columns()
    return customer_profile(txns).where(F.col("salary_months") > 0).select(
        "customer_id",
        "salary_months",
        columns["salary_variance_12m"].alias("salary_variance_12m"),
        columns["salary_amount_median"].alias("salary_amount_median"),
    )


def income_growth(txns: DataFrame) -> DataFrame:
    return customer_profile(txns).select(
        "customer_id",
        F.col("span").alias("months"),
        income_columns()["income_growth_pct"].alias("income_growth_pct"),
    )
