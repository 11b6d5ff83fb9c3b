"""Cash-flow features over the trailing six and three calendar months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import (
    completeness,
    middle,
    money,
    ratio,
    safe_divide,
    spread,
)
from tallyscope.operators.monthly import customer_profile, tail


def cashflow_columns() -> dict[str, Column]:
    """Cash-flow features over a profile row."""
    six = F.least(F.lit(6), F.col("span"))
    three = F.least(F.lit(3), F.col("span"))
    credits, debits = tail("credits", six), tail("debits", six)

    saved = F.transform(
        F.arrays_zip(credits.alias("c"), debits.alias("d")),
        lambda m: F.when(
            m["c"] > 0, F.try_divide((m["c"] - m["d"]).cast("double"), m["c"].cast("double"))
        ).otherwise(F.lit(0.0)),
    )
    net = F.transform(
        F.arrays_zip(tail("credits", three).alias("c"), tail("debits", three).alias("d")),
        lambda m: m["c"] - m["d"],
    )
    spent = F.transform(debits, lambda x: x.cast("double"))
    mean = F.aggregate(spent, F.lit(0.0), lambda acc, x: acc + x) / six
    return {
        "avg_monthly_income": money(middle(credits)),
        "avg_monthly_outflow": money(middle(debits)),
        "savings_ratio_6m": ratio(middle(saved)),
        "liquidity_buffer": money(F.array_min(net)),
        "expense_volatility": F.when(
            six > 1, ratio(safe_divide(spread(spent, six), mean))
        ).otherwise(F.lit(0.0)),
    }


def cashflow_features(txns: DataFrame) -> DataFrame:
    columns = [value.alias(name) for name, value in cashflow_columns().items()]
    return customer_profile(txns).select(
        "customer_id", *columns, completeness(F.col("span")).alias("completeness")
    )
