"""Subscription cleansing: several discretionary series that stop close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.columns import in_series, is_debit, ratio, spread_of
from tallyscope.operators.base import activity_cells
from tallyscope.operators.monthly import customer_profile
from tallyscope.schemas import DISCRETIONARY

MIN_PAYMENTS = 3
MIN_SERIES = 3
IDLE_DAYS = 30
CLUSTER_DAYS = 60
MAX_INCOME_CV = 0.3


def series_ends(txns: DataFrame) -> DataFrame:
    """Per customer: the end dates of discretionary series, and where three of them cluster.

    ``ends`` counts series by the day of their last payment, so it has at most one entry per
    calendar day however many series a customer has. ``cluster_end`` is the earliest day that
    closes a run of three ends within the cluster window. Three copies of a day are enough to
    find any such run, so the two-step look-ahead works on a bounded number of rows.
    """
    series = (
        activity_cells(txns)
        .where(is_debit() & in_series() & F.col("merchant_category").isin(DISCRETIONARY))
        .groupBy("customer_id", "recurring_group_id")
        .agg(F.sum("rows").alias("payments"), F.max("last_date").alias("ended"))
        .where(F.col("payments") >= MIN_PAYMENTS)
    )
    days = series.groupBy("customer_id", "ended").agg(F.count(F.lit(1)).alias("n"))
    copies = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(3)).cast("int"))
    by_end = Window.partitionBy("customer_id").orderBy("ended", "copy")
    return (
        days.select("customer_id", "ended", "n", F.explode(copies).alias("copy"))
        .withColumn("third", F.lead("ended", 2).over(by_end))
        .groupBy("customer_id")
        .agg(
            F.collect_list(F.when(F.col("copy") == 1, F.struct("ended", "n"))).alias("ends"),
            F.min(
                F.when(F.datediff("third", "ended") <= CLUSTER_DAYS, F.col("third"))
            ).alias("cluster_end"),
        )
    )


def subscription_columns(max_income_cv: float = MAX_INCOME_CV) -> dict[str, Column]:
    """Flag and score over a profile row joined with ``series_ends``."""
    span = F.col("credits_last") - F.col("credits_first") + 1
    mean = F.col("credits_sum").cast("double") / span
    spread = spread_of(span, F.col("credits_sum"), F.col("credits_sq"))
    variance = F.try_divide(spread, (span * (span - 1)).cast("double"))
    cv = F.when(mean > 0, F.try_divide(F.sqrt(F.greatest(variance, F.lit(0.0))), mean))
    steady = (span >= 3) & (F.coalesce(cv, F.lit(1.0)) < max_income_cv)

    idle_since = F.date_sub("last_date", IDLE_DAYS)
    add = lambda acc, e: acc + e["n"]
    series = F.aggregate("ends", F.lit(0).cast("bigint"), add)
    stopped = F.aggregate(
        F.filter("ends", lambda e: e["ended"] <= idle_since), F.lit(0).cast("bigint"), add
    )
    flag = F.coalesce(
        steady & (series >= MIN_SERIES) & (F.col("cluster_end") <= idle_since), F.lit(False)
    )
    return {
        "subscription_cleansing_flag": flag.cast("double"),
        "subscription_cleansing_score": F.when(
            flag, ratio(F.try_divide(stopped.cast("double"), series.cast("double")))
        ).otherwise(F.lit(0.0)),
    }


def subscription_cleansing(txns: DataFrame, max_income_cv: float = MAX_INCOME_CV) -> DataFrame:
    columns = [value.alias(name) for name, value in subscription_columns(max_income_cv).items()]
    return (
        customer_profile(txns)
        .join(series_ends(txns), "customer_id", "left")
        .select("customer_id", *columns)
    )
