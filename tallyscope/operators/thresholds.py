"""Gate threshold updates: validation, change log and the updated table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["max_dti", "min_vintage_months", "min_confidence"]


def validate_updates(updates: DataFrame) -> DataFrame:
    """Adds ``errors``; a NULL field means "leave unchanged" and is always valid."""

    def outside_unit(name: str):
        return F.when(~F.col(name).between(0, 1), F.concat(
            F.lit(f"{name} must be between 0 and 1, got "), F.col(name).cast("string")))

    vintage = F.when(F.col("min_vintage_months") < 1, F.concat(
        F.lit("min_vintage_months must be a positive integer, got "),
        F.col("min_vintage_months").cast("string")))
    errors = F.array_compact(
        F.array(outside_unit("max_dti"), vintage, outside_unit("min_confidence"))
    )
    return updates.withColumn("errors", errors)


def valid_updates(updates: DataFrame) -> DataFrame:
    return validate_updates(updates).where(F.size("errors") == 0).drop("errors")


def unknown_products(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates for products that have no thresholds; callers treat these as an error."""
    return updates.join(current.select("product"), "product", "left_anti")


def _long(table: DataFrame, value: str) -> DataFrame:
    cells = [
        F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("number"),
                 F.col(f).cast("string").alias(value))
        for f in FIELDS
    ]
    return table.select("product", F.inline(F.array(*cells)))


def threshold_changes(current: DataFrame, updates: DataFrame, role: str) -> DataFrame:
    """One log row per field whose new value is given and differs from the stored one."""
    old = _long(current, "old_value").withColumnRenamed("number", "old_number")
    new = _long(updates, "new_value").where(F.col("new_value").isNotNull())
    return (
        old.join(new, ["product", "field_name"])
        .where(~F.col("old_number").eqNullSafe(F.col("number")))
        .select(
            F.lit(role).alias("changed_by_role"),
            "product",
            "field_name",
            F.coalesce("old_value", F.lit("None")).alias("old_value"),
            "new_value",
            F.current_timestamp().alias("created_at"),
        )
    )


def apply_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The threshold table after the updates; one update row per product."""
    given = updates.select("product", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    return current.join(given, "product", "left").select(
        "product", *[F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in FIELDS]
    )
