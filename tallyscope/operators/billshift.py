"""Bill shift: utility and rent series whose payment day moves towards month end."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.isolation import SUBSAMPLE, TREES, grow, grow_many
from tallyscope.functions.isolation import score as anomaly_score
from tallyscope.functions.columns import in_series, is_debit
from tallyscope.operators.base import day_cells
from tallyscope.operators.quantile import exact_quantile
from tallyscope.schemas import BILLS
from tallyscope.session import staged

MIN_BILLS = 6
MIN_PAYMENTS = 5
MIN_DRIFT = 3.0
MIN_SCORE = 0.4
OUTLIER_SHARE = 0.3
SEED = 42
#: Model parameters: a forest's trees times the subsample of each.
FOREST_ROWS = TREES * SUBSAMPLE
#: Rows that are scored together; no score depends on it.
CHUNK_ROWS = 50_000
#: Points of all trees that short series grow together in a task; no score depends on it.
GROWN_POINTS = 1_000_000
SERIES = ["customer_id", "recurring_group_id"]


def bills(txns: DataFrame) -> DataFrame:
    """Day cells of utility and rent series."""
    return day_cells(txns).where(
        is_debit() & F.col("merchant_category").isin(BILLS) & in_series())


def series_drift(txns: DataFrame) -> DataFrame:
    """Mean payment day of the later half minus that of the earlier half, per series.

    Rows are first counted per day. Rows of one day share their day of month, so the halves
    can be cut from running counts and a series costs at most one row per calendar day.
    """
    days = bills(txns).groupBy(*SERIES, "date").agg(F.sum("rows").alias("n"))
    whole = Window.partitionBy(*SERIES)
    before = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    early = F.greatest(
        F.lit(0), F.least(F.col("n"), F.floor(F.col("payments") / 2) - F.col("before"))
    )
    day = F.dayofmonth("date")
    parts = (
        days.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("payments", F.sum("n").over(whole))
        .withColumn("early", early)
        .groupBy(*SERIES)
        .agg(
            F.max("payments").alias("payments"),
            F.sum("early").alias("early"),
            F.sum(day * F.col("early")).alias("early_days"),
            F.sum(day * (F.col("n") - F.col("early"))).alias("late_days"),
        )
    )
    mean_early = F.try_divide(F.col("early_days").cast("double"), F.col("early").cast("double"))
    late = (F.col("payments") - F.col("early")).cast("double")
    mean_late = F.try_divide(F.col("late_days").cast("double"), late)
    return parts.select(
        *SERIES,
        "payments",
        F.when(F.col("payments") >= MIN_PAYMENTS, mean_late - mean_early).alias("drift"),
    )


def bill_shift_drift(txns: DataFrame) -> DataFrame:
    """Per customer: bills, series that drift by more than three days, the largest drift."""
    drifts = F.col("drift") > MIN_DRIFT
    return (
        series_drift(txns)
        .groupBy("customer_id")
        .agg(
            F.sum("payments").alias("bills"),
            F.count_if(drifts).alias("drifting_series"),
            F.max(F.when(drifts, F.round("drift", 4))).alias("largest_drift"),
        )
        .where(F.col("bills") >= MIN_BILLS)
    )


def _points(frame: pd.DataFrame) -> np.ndarray:
    return frame[["day", "amount"]].to_numpy(dtype=float)


def _grow_packed(frame: pd.DataFrame) -> pd.DataFrame:
    forest = grow(_points(frame.sort_values(["draw", "date", "amount", "copy"])), SEED)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **forest)
    return pd.DataFrame({
        "customer_id": [frame["customer_id"].iloc[0]],
        "recurring_group_id": [frame["recurring_group_id"].iloc[0]],
        "forest": [buffer.getvalue()],
    })


def _score_chunk(rows: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
    columns = ["customer_id", "recurring_group_id", "date", "amount", "n"]
    if rows.empty or forests.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*columns, "score"]})
    forest = dict(np.load(io.BytesIO(forests["forest"].iloc[0])))
    return rows[columns].assign(score=anomaly_score(forest, _points(rows)))


def _forests(cells: DataFrame) -> DataFrame:
    """A packed forest per series, grown from its ``FOREST_ROWS`` rows of lowest hash.

    Each tree draws its subsample from these rows, all the trees together can't see more. Spark
    applies the rank filter before the shuffle too, so a series of any length sends this many
    rows per task at most.
    """
    copies = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(FOREST_ROWS)).cast("int"))
    rows = cells.select(*SERIES, "date", "day", "amount", F.explode(copies).alias("copy")).withColumn(
        "draw", F.xxhash64(*SERIES, "date", "amount", "copy"))
    lowest = Window.partitionBy(*SERIES).orderBy("draw", "date", "amount", "copy")
    return (
        rows.withColumn("_rank", F.row_number().over(lowest))
        .where(F.col("_rank") <= FOREST_ROWS).drop("_rank")
        .groupBy(*SERIES)
        .applyInPandas(_grow_packed,
                       "customer_id string, recurring_group_id string, forest binary")
    )


SCORED = "customer_id string, recurring_group_id string, date date, amount double, n bigint, score double"


def _score_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of whole series, an array of cells each; series of one length grow together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("cells")
        ends = np.asarray(lists.offsets)
        starts, cells = ends[:-1] - ends[0], lists.flatten()
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        points = np.column_stack([
            cells.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for name in ("day", "amount")])
        times = cells.field("n").to_numpy(zero_copy_only=False)
        payments = np.bincount(owner, times, len(sizes)).astype(int)
        scores = np.empty(len(owner))
        for length in np.unique(payments):
            alike = np.flatnonzero(payments == length)
            step = max(1, GROWN_POINTS // (TREES * length))
            for group in np.split(alike, range(step, len(alike), step)):
                mine = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in group])
                rows = np.repeat(mine, times[mine])
                forests = grow_many(points[rows].reshape(len(group), length, 2), SEED)
                scores[mine] = anomaly_score(
                    forests, points[mine], np.repeat(np.arange(len(group)), sizes[group]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name).take(pa.array(owner)) for name in SERIES),
             *(cells.field(name) for name in ("date", "amount", "n")), pa.array(scores)],
            names=[*SERIES, "date", "amount", "n", "score"])


def _short_scores(cells: DataFrame, parallel: int) -> DataFrame:
    """Scores of the series whose trees see all of their rows, ``SUBSAMPLE`` at most."""
    cell = F.struct("date", "day", F.col("amount"), "n")
    return (
        cells.repartition(parallel, *SERIES)
        .groupBy(*SERIES).agg(F.collect_list(cell).alias("cells"))
        .mapInArrow(_score_short, SCORED)
    )


def series_scores(
    txns: DataFrame, drift: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Isolation score in [0, 1] for every drifting series, long or short.

    ``drift`` is the written result of ``series_drift``, one small row per series: it decides
    which rows are read again. Identical (date, amount) rows are counted once. Series of up to
    ``SUBSAMPLE`` rows, whose trees see all rows in whatever order, are grown and scored many at a
    time. The rows of longer ones are dealt into chunks of about ``chunk_rows`` rows that each meet
    their series' forest; a row's score depends on the forest alone, so chunks of any size give the
    same scores. The offset is the exact quantile of all scores.
    """
    drift = staged(series_drift(txns)) if drift is None else drift
    drifting = drift.where(F.col("drift") > MIN_DRIFT).drop("drift")
    points = bills(txns).select(*SERIES, "date", F.dayofmonth("date").alias("day"),
                                F.col("amount").cast("double").alias("amount"), "rows")
    # forests cost far more time than bytes, so small groups must not be merged into one task
    parallel = int(txns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = staged(
        points.join(drifting, SERIES)
        .groupBy(*SERIES, "date", "day", "amount", "payments").agg(F.sum("rows").alias("n"))
    )
    short = F.col("payments") <= SUBSAMPLE
    many, long_series = cells.where(~short), drifting.where(~short)
    chunks = F.ceil(F.col("payments") / chunk_rows).cast("int")
    dealt = many.withColumn("chunk", F.pmod(F.xxhash64("date", "amount"), chunks).cast("int"))
    per_chunk = long_series.select(
        *SERIES, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")
    ).join(_forests(many), SERIES)
    per_chunk = per_chunk.toDF(*per_chunk.columns)
    keys = [*SERIES, "chunk"]
    in_chunks = (
        dealt.repartition(parallel, *keys).groupBy(*keys)
        .cogroup(per_chunk.repartition(parallel, *keys).groupBy(*keys))
        .applyInPandas(_score_chunk, SCORED)
    )
    scored = staged(_short_scores(cells.where(short), parallel).unionByName(in_chunks))
    # the later half starts at rank floor(payments / 2) in (date, amount) order
    by_day = scored.groupBy(*SERIES, "date").agg(F.sum("n").alias("rows"))
    whole = Window.partitionBy(*SERIES)
    days = (
        by_day.withColumn("upto", F.sum("rows").over(whole.orderBy("date")))
        .withColumn("half", F.floor(F.sum("rows").over(whole) / 2))
        .select(*SERIES, "date", "half", (F.col("upto") - F.col("rows")).alias("before"),
                "upto")
        .where(F.col("upto") > F.col("half"))
    )
    # only the day that contains the cut needs its rows in order
    dated = scored.join(days, [*SERIES, "date"])
    on_day = Window.partitionBy(*SERIES, "date").orderBy("amount")
    cut_day = (
        dated.where(F.col("before") < F.col("half"))
        .withColumn("reach", F.col("before") + F.sum("n").over(on_day))
        .where(F.col("reach") > F.col("half"))
    )
    later = (
        dated.where(F.col("before") >= F.col("half")).select(*SERIES, "score")
        .unionByName(cut_day.select(*SERIES, "score"))
        .groupBy(*SERIES)
        .agg(F.min("score").alias("worst"))
    )
    offsets = exact_quantile(scored, SERIES, "score", OUTLIER_SHARE, 1e-4, "offset", weight="n")
    score = F.lit(0.5) - (F.col("worst") - F.col("offset"))
    return later.join(offsets, SERIES).select(
        *SERIES, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")
    )


def bill_scores(txns: DataFrame) -> DataFrame:
    """Per customer with bills: their number and the highest score above the flag limit."""
    drift = staged(series_drift(txns))
    counts = drift.groupBy("customer_id").agg(F.sum("payments").alias("bills"))
    best = series_scores(txns, drift).groupBy("customer_id").agg(
        F.max(F.when(F.col("score") > MIN_SCORE, F.col("score"))).alias("bill_score")
    )
    return counts.join(best, "customer_id", "left")


def bill_shift_columns() -> dict[str, Column]:
    """Flag and score over a row joined with ``bill_scores``."""
    flag = F.coalesce(
        (F.col("bills") >= MIN_BILLS) & F.col("bill_score").isNotNull(), F.lit(False)
    )
    return {
        "bill_shift_flag": flag.cast("double"),
        "bill_shift_score": F.when(flag, F.round("bill_score", 4)).otherwise(F.lit(0.0)),
    }


def bill_shift(txns: DataFrame) -> DataFrame:
    columns = [value.alias(name) for name, value in bill_shift_columns().items()]
    return (
        txns.select("customer_id").distinct()
        .join(bill_scores(txns), "customer_id", "left")
        .select("customer_id", *columns)
    )
