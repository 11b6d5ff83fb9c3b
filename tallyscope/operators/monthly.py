"""Monthly series per customer: sparse sums, the gap-filled series and a one-row profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.columns import is_credit, is_debit, money, month_start
from tallyscope.operators.base import activity_cells


def monthly_activity(txns: DataFrame) -> DataFrame:
    """One row per customer and month that has a transaction.

    ``credits``, ``debits`` and ``salary`` are NULL when the month has no such row, which keeps
    "no credit" apart from "credits of zero". The map-side combine leaves at most one row per
    customer, month and task, so a customer with very many rows does not form a hot partition.
    """
    salary = is_credit() & (F.col("merchant_category") == "salary")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("amount"))).cast("decimal(28,2)")

    return activity_cells(txns).groupBy("customer_id", "month_idx").agg(
        total(is_credit()).alias("credits"),
        total(is_debit()).alias("debits"),
        total(salary).alias("salary"),
        F.min(F.when(salary, F.col("first_date"))).alias("first_salary"),
        F.max("last_date").alias("last_date"),
    )


def monthly_cashflow(txns: DataFrame) -> DataFrame:
    """Credits and debits for every month between a customer's first and last transaction.

    Each month row also produces the empty months up to the next one, so filling the gaps
    needs neither a calendar table nor a self-join.
    """
    by_month = Window.partitionBy("customer_id").orderBy("month_idx")
    upto = F.coalesce(F.lead("month_idx").over(by_month) - 1, F.col("month_idx"))
    zero = F.lit(0).cast("decimal(28,2)")
    own = F.col("filled") == F.col("month_idx")
    return (
        monthly_activity(txns)
        .withColumn("upto", upto)
        .select("customer_id", "month_idx", "credits", "debits",
                F.explode(F.sequence("month_idx", "upto")).alias("filled"))
        .select(
            "customer_id",
            month_start(F.col("filled")).alias("month"),
            F.coalesce(F.when(own, F.col("credits")), zero).alias("credits"),
            F.coalesce(F.when(own, F.col("debits")), zero).alias("debits"),
        )
    )


def _series(name: str) -> list[Column]:
    """Span, sum and index-weighted sum of one monthly series."""
    value = F.col(name)
    there = F.when(value.isNotNull(), F.col("month_idx"))
    return [
        F.min(there).alias(f"{name}_first"),
        F.max(there).alias(f"{name}_last"),
        F.sum(value).alias(f"{name}_sum"),
        F.sum(F.col("month_idx").cast("decimal(8,0)") * value).alias(f"{name}_moment"),
    ]


def customer_profile(txns: DataFrame) -> DataFrame:
    """One row per customer with everything the monthly features need.

    All collected arrays hold one entry per calendar month, so their length is bounded by the
    calendar and not by the number of transactions. Income, cash-flow and debt-trend features
    are then plain column expressions over this row, with no further shuffle. A customer's months
    lie in as many tasks: the rows are sent as they are, arrays are collected where they meet.
    """
    newest = F.sort_array(
        F.collect_list(F.struct("month_idx", "credits", "debits")), asc=False
    )
    salary = F.col("salary").cast("double")
    return (
        monthly_activity(txns)
        .repartition("customer_id")
        .groupBy("customer_id")
        .agg(
            F.min("month_idx").alias("first_idx"),
            F.max("month_idx").alias("last_idx"),
            F.count(F.lit(1)).cast("int").alias("active_months"),
            F.max("last_date").alias("last_date"),
            F.min("first_salary").alias("first_salary"),
            *_series("credits"),
            *_series("debits"),
            F.sum(F.col("credits").cast("decimal(19,2)") * F.col("credits").cast("decimal(19,2)")
                  ).alias("credits_sq"),
            F.avg(salary).alias("salary_mean"),
            F.stddev_samp(salary).alias("salary_std"),
            F.count("salary").alias("salary_months"),
            F.collect_list("salary").alias("salaries"),
            F.slice(newest, 1, 6).alias("newest"),
        )
        .withColumn("span", F.col("last_idx") - F.col("first_idx") + 1)
    )


def tail(field: str, k: Column, months: str = "newest") -> Column:
    """Values of the last ``k`` calendar months, zero where a month has no row.

    The order is not kept: every consumer is a median, minimum or deviation.
    """
    recent = F.filter(F.col(months), lambda m: m["month_idx"] > F.col("last_idx") - k)
    zero = F.lit(0).cast("decimal(28,2)")
    there = F.transform(recent, lambda m: F.coalesce(m[field].cast("decimal(28,2)"), zero))
    return F.concat(there, F.array_repeat(zero, k - F.size(recent)))


def minimal_features(txns: DataFrame) -> DataFrame:
    """The older averages: means over the months that have a transaction, without gap filling."""
    zero = F.lit(0).cast("decimal(28,2)")
    income = F.coalesce(F.col("credits_sum").cast("decimal(28,2)"), zero)
    outflow = F.coalesce(F.col("debits_sum").cast("decimal(28,2)"), zero)
    months = F.col("active_months")
    saved = F.try_divide((income - outflow).cast("double"), income.cast("double"))
    return (
        monthly_activity(txns)
        .groupBy("customer_id")
        .agg(F.sum("credits").alias("credits_sum"), F.sum("debits").alias("debits_sum"),
             F.count(F.lit(1)).alias("active_months"))
        .select(
            "customer_id",
            money(income / months).alias("avg_monthly_income"),
            money(outflow / months).alias("avg_monthly_outflow"),
            F.round(saved, 4).alias("savings_ratio"),
        )
    )
