"""The long feature table: build, merge, read as of a date, pivot to vectors, range warnings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import completeness
from tallyscope.operators.base import Base
from tallyscope.operators.billshift import bill_scores, bill_shift_columns
from tallyscope.operators.cashflow import cashflow_columns
from tallyscope.operators.debt import debt_columns, emi_totals
from tallyscope.operators.income import income_columns, income_sources
from tallyscope.operators.monthly import customer_profile
from tallyscope.operators.pooling import first_open_maturity, pooling_columns
from tallyscope.operators.subscription import series_ends, subscription_columns
from tallyscope.schemas import FEATURE_NAMES, FEATURE_RUNS, FEATURE_SCHEMA_VERSION, RATIO_FEATURES
from tallyscope.session import staged

KEY = ["customer_id", "feature_name", "computed_at"]
#: Characters of a failed group's message that its outcome row keeps.
MESSAGE_CHARS = 500

# group -> (extra one-row-per-customer input or None, columns, data completeness)
FeatureGroup = tuple[
    Callable[[Base], DataFrame] | None, Callable[[], dict[str, Column]], Callable[[], Column]
]
ALL_DATA = lambda: F.lit(1.0)
FEATURE_FUNCTIONS: dict[str, FeatureGroup] = {
    "income": (lambda b: income_sources(b.activity), income_columns,
               lambda: completeness(F.col("active_months"))),
    "cashflow": (None, cashflow_columns, lambda: completeness(F.col("span"))),
    "debt": (lambda b: emi_totals(b.activity), debt_columns,
             lambda: completeness(F.col("active_months"))),
    "subscription_cleansing": (lambda b: series_ends(b.activity), subscription_columns,
                               ALL_DATA),
    "liquidity_pooling": (lambda b: first_open_maturity(b.days), pooling_columns, ALL_DATA),
    "bill_shift": (lambda b: bill_scores(b.days), bill_shift_columns, ALL_DATA),
}


def customers_with_txns(txns: DataFrame) -> DataFrame:
    return txns.select("customer_id").distinct()


def feature_groups(max_income_cv: float | None = None) -> dict[str, FeatureGroup]:
    """The registry, with the income-stability limit replaced when one is given."""
    groups = dict(FEATURE_FUNCTIONS)
    if max_income_cv is not None:
        inputs, _, complete = groups["subscription_cleansing"]
        groups["subscription_cleansing"] = (
            inputs, lambda: subscription_columns(max_income_cv), complete
        )
    return groups


def features_wide(
    txns: DataFrame | Base, groups: dict[str, FeatureGroup] | None = None
) -> DataFrame:
    """All features of all customers, one row each, plus one completeness column per group.

    The raw transactions are read when this is called, once per base table that the groups need,
    and not again when the result is. Every input is already one row per customer and hashed by customer, so the joins add no
    exchange and cannot be skewed by a customer with many transactions.
    """
    groups = feature_groups() if groups is None else groups
    base = txns if isinstance(txns, Base) else Base(txns)
    return _wide(customer_profile(base.activity), base, groups)


def _wide(profile: DataFrame, base: Base, groups: dict[str, FeatureGroup]) -> DataFrame:
    wide = profile
    for inputs, _, _ in groups.values():
        if inputs is not None:
            wide = wide.join(inputs(base), "customer_id", "left")
    columns = []
    for name, (_, features, complete) in groups.items():
        columns += [value.alias(feature) for feature, value in features().items()]
        columns.append(complete().alias(f"_completeness_{name}"))
    return wide.select("customer_id", *columns)


def to_long(wide: DataFrame, groups: dict[str, FeatureGroup], computed_at: dt.date) -> DataFrame:
    """One row per customer and feature that could be computed."""
    entries = [
        F.struct(
            F.lit(feature).alias("feature_name"),
            F.col(feature).alias("feature_value"),
            F.col(f"_completeness_{name}").alias("data_completeness_score"),
        )
        for name, (_, features, _) in groups.items()
        for feature in features()
    ]
    return (
        wide.select("customer_id", F.inline(F.array(*entries)))
        .where(F.col("feature_value").isNotNull())
        .select(
            "customer_id",
            "feature_name",
            "feature_value",
            F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
            "data_completeness_score",
            F.lit(computed_at).cast("date").alias("computed_at"),
        )
    )


def features_long(
    txns: DataFrame | Base, computed_at: dt.date, groups: dict[str, FeatureGroup] | None = None
) -> DataFrame:
    groups = feature_groups() if groups is None else groups
    return to_long(features_wide(txns, groups), groups, computed_at)


def features_by_group(
    txns: DataFrame | Base, computed_at: dt.date, groups: dict[str, FeatureGroup] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The long features of every group that could be computed, and an outcome row per group:
    group_name, state (stored or failed), features, message, computed_at.

    Each group is a job of its own over the base tables and the profile, which are written once,
    so a group that fails, while its plan is built or while it runs, leaves the others whole.
    """
    groups = feature_groups() if groups is None else groups
    base = txns if isinstance(txns, Base) else Base(txns)
    profile = staged(customer_profile(base.activity), "profile")
    done, outcomes = [], []
    for name, group in groups.items():
        one = {name: group}
        try:
            rows = staged(to_long(_wide(profile, base, one), one, computed_at), f"group-{name}")
            outcomes.append((name, "stored", rows.count(), None, computed_at))
            done.append(rows)
        except Exception as failure:  # whatever a group's code raises is its outcome
            outcomes.append((name, "failed", 0, str(failure)[:MESSAGE_CHARS], computed_at))
    if not done:
        raise RuntimeError(f"all feature groups failed: {outcomes}")
    spark = profile.sparkSession
    return reduce(DataFrame.unionByName, done), spark.createDataFrame(outcomes, FEATURE_RUNS)


def merge_features(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace stored rows of the same key; stored rows without a new one stay."""
    kept = existing.join(new.select(*KEY), KEY, "left_anti")
    return kept.unionByName(new)


def features_as_of(features: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Latest value of each feature, optionally on or before a date."""
    if as_of is not None:
        features = features.where(F.col("computed_at") <= F.lit(as_of))
    return features.groupBy("customer_id", "feature_name").agg(
        F.max_by("feature_value", "computed_at").alias("feature_value"),
        F.max("computed_at").alias("computed_at"),
    )


def feature_vectors(
    features: DataFrame, as_of: dt.date | None = None, names: list[str] | None = None
) -> DataFrame:
    """Latest features as one row per customer: as-of choice and pivot in one aggregation."""
    if as_of is not None:
        features = features.where(F.col("computed_at") <= F.lit(as_of))
    latest = []
    for name in names or FEATURE_NAMES:
        mine = F.col("feature_name") == name
        latest.append(
            F.max_by(
                F.when(mine, F.col("feature_value")), F.when(mine, F.col("computed_at"))
            ).alias(name)
        )
    return features.groupBy("customer_id").agg(*latest)


def feature_warnings(features: DataFrame) -> DataFrame:
    """Stored ratio features outside [0, 1.5]. The rows stay in the table."""
    return features.where(
        F.col("feature_name").isin(RATIO_FEATURES) & ~F.col("feature_value").between(0.0, 1.5)
    ).select("customer_id", "feature_name", "feature_value")
