"""The feature job: base tables, then group by group, merged into one day's partition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators import store
from tallyscope.schemas import FEATURE_RUNS, TRANSACTIONS
from tallyscope.sources import tables


def run_nightly(
    spark: SparkSession, root: str, computed_at: dt.date | None = None,
    groups: dict[str, store.FeatureGroup] | None = None,
) -> dict[str, int]:
    """Compute and store features; returns counts of customers, features, warnings and groups
    that failed.

    Safe to run again on the same day. A failing group leaves the others stored; the outcome of
    every group is added to the table ``feature_runs`` after the features are stored.
    """
    computed_at = computed_at or dt.date.today()
    txns = tables.read(spark, root, "transactions", TRANSACTIONS)
    features, outcomes = store.features_by_group(txns, computed_at, groups)
    tables.write_features(features, root, computed_at)
    tables.append(outcomes, root, "feature_runs", FEATURE_RUNS)
    # of the day before, so that another run on this day leaves the state as it is
    tables.refresh_feature_state(spark, root, computed_at - dt.timedelta(days=1))
    counts = features.agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count(F.lit(1)).alias("features"),
    ).first()
    return {**counts.asDict(), "warnings": store.feature_warnings(features).count(),
            "failed_groups": outcomes.where("state = 'failed'").count()}


def load_vectors(
    spark: SparkSession, root: str, as_of: dt.date | None = None,
    customer_id: str | None = None,
) -> DataFrame:
    """Latest feature vectors, of all customers or of one; an unknown customer is an error.

    Reads the newest kept state on or before the day and the days after it.
    """
    features = tables.read_features(spark, root, as_of)
    if customer_id is not None:
        features = features.where(F.col("customer_id") == customer_id)
    vectors = store.feature_vectors(features, as_of)
    if customer_id is not None and vectors.isEmpty():
        raise ValueError(f"no features for customer_id={customer_id}")
    return vectors
