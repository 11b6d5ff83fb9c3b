"""Exact interpolated quantiles per key that stay distributed when one key is very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(
    df: DataFrame,
    keys: list[str],
    value: str,
    q: float,
    width: float,
    name: str,
    wanted: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``keys`` plus the linearly interpolated ``q``-quantile of ``value``, as ``name``.

    A built-in exact percentile holds all distinct values of a key in one buffer. Here the
    values are counted into buckets of ``width`` first; the running bucket counts show which
    bucket holds the wanted rank, and only that bucket's distinct values are ordered. Each
    window sees the buckets of one key or the distinct values of one bucket, never all rows
    of a key. ``wanted`` limits the work to some keys; ``weight`` names a row-count column.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # a bucket number that cannot be NULL keeps both readers of the cells on one shuffle
    bucket = F.coalesce(F.floor(F.col("_v") / F.lit(width)), F.lit(0))
    known = F.col(value).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    cells = (
        df.where(known)
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(times.alias("_n"))
        .withColumn("_b", bucket)
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    rank = (F.col("_total") - 1) * F.lit(q)
    targets = (
        cells.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_bucket))
        .withColumn("_total", F.sum("_n").over(whole))
        .select(*keys, "_b", "_upto", (F.col("_upto") - F.col("_n")).alias("_before"),
                F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"),
                (rank - F.floor(rank)).alias("_share"))
        .where((F.col("_upto") > F.col("_low")) & (F.col("_before") <= F.col("_high")))
        .drop("_upto")
    )
    if wanted is not None:
        targets = targets.join(wanted.select(*keys).distinct(), keys, "left_semi")

    by_value = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        cells.join(targets, [*keys, "_b"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def at(position: str):
        hit = (F.col("_from") <= F.col(position)) & (F.col("_upto") > F.col(position))
        return F.max(F.when(hit, F.col("_v")))

    low, high = F.col("_lo"), F.col("_hi")
    if q == 0.5:
        # halves stay exact in decimal arithmetic
        result = (low + high) / 2
    else:
        result = low + (high - low) * F.col("_s")
    return (
        ranked.groupBy(*keys)
        .agg(at("_low").alias("_lo"), at("_high").alias("_hi"), F.max("_share").alias("_s"))
        .select(*keys, result.alias(name))
    )
