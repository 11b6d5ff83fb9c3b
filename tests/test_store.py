"""Feature table: idempotent runs, merging, as-of reads, vectors, warnings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import store
from tallyscope.operators.base import Base, combined_activity, combined_days
from tallyscope.operators.billshift import series_drift
from tallyscope.operators.debt import emi_totals
from tallyscope.operators.income import income_sources
from tallyscope.operators.monthly import customer_profile
from tallyscope.operators.pooling import open_maturities
from tallyscope.operators.subscription import series_ends
from tallyscope.plans import nightly
from tallyscope.schemas import AUDIT_LOG, FEATURE_NAMES, FEATURE_RUNS, FEATURES, TRANSACTIONS
from tallyscope.sources import tables
from test_features import EXPECTED, worked_example

DAY = dt.date(2024, 5, 1)


def row(customer, name, value, day):
    return (customer, name, value, "1.0.0", 1.0, dt.date.fromisoformat(day))


@pytest.fixture
def history(spark):
    return spark.createDataFrame([
        row("c1", "current_dti", 0.1, "2024-01-01"),
        row("c1", "current_dti", 0.2, "2024-02-01"),
        row("c1", "savings_ratio_6m", -0.5, "2024-01-01"),
        row("c2", "current_dti", 0.3, "2024-03-01"),
    ], FEATURES)


def test_nightly_twice_keeps_the_row_count(spark, make_txns, tmp_path):
    root = str(tmp_path)
    tables.append_transactions(make_txns(worked_example()), root)
    for _ in range(2):
        counts = nightly.run_nightly(spark, root, DAY)
        assert counts == {"customers": 1, "features": 20, "warnings": 0, "failed_groups": 0}
        stored = tables.read(spark, root, "features", FEATURES)
        assert stored.count() == 20
    nightly.run_nightly(spark, root, dt.date(2024, 5, 2))
    stored = tables.read(spark, root, "features", FEATURES)
    assert stored.count() == 40
    assert {r["data_completeness_score"] for r in stored.collect()} == {0.3333, 1.0}
    vector = nightly.load_vectors(spark, root, customer_id="c1").first().asDict()
    assert {n: vector[n] for n in EXPECTED} == EXPECTED
    with pytest.raises(ValueError):
        nightly.load_vectors(spark, root, customer_id="nobody")


def test_a_failing_group_leaves_the_others_stored(spark, make_txns, tmp_path):
    root = str(tmp_path)
    tables.append_transactions(make_txns(worked_example()), root)

    def broken(base):
        raise ZeroDivisionError("no such column")

    late = F.raise_error(F.lit("at run time"))
    groups = store.feature_groups()
    groups["debt"] = (broken, *groups["debt"][1:])
    groups["income"] = (groups["income"][0], lambda: {"income_growth_pct": late.cast("double")},
                        store.ALL_DATA)
    counts = nightly.run_nightly(spark, root, DAY, groups)
    assert counts == {"customers": 1, "features": 11, "warnings": 0, "failed_groups": 2}
    stored = tables.read(spark, root, "features", FEATURES)
    assert {r["feature_name"] for r in stored.collect()}.isdisjoint({"current_dti", "income_growth_pct"})
    runs = {r["group_name"]: r for r in tables.read(spark, root, "feature_runs", FEATURE_RUNS).collect()}
    assert runs["debt"]["state"] == runs["income"]["state"] == "failed"
    assert "no such column" in runs["debt"]["message"] and "at run time" in runs["income"]["message"]
    assert runs["cashflow"]["features"] == 5 and runs["cashflow"]["message"] is None
    with pytest.raises(RuntimeError):
        nightly.run_nightly(spark, root, DAY, {"debt": groups["debt"]})


def test_the_raw_table_is_read_twice_at_most(spark, make_txns, tmp_path):
    """Once written, the base tables are all that the features' plan reads."""
    root = str(tmp_path)
    tables.append_transactions(make_txns(worked_example()), root)
    txns = tables.read(spark, root, "transactions", TRANSACTIONS)
    features = store.features_long(txns, DAY)
    assert not [f for f in features.inputFiles() if "/transactions/" in f]
    base = Base(txns)
    for cells in (combined_activity(txns), combined_days(txns)):
        plan = cells._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("FileScan") == 1
    again = store.features_long(base, DAY)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, features.collect()))


def unordered(df):
    """Rows as text, with collected lists in order: their order isn't part of a result."""
    return sorted(str([sorted(map(str, v)) if isinstance(v, list) else v for v in r])
                  for r in df.collect())


def test_combined_cells_give_the_features_of_the_rows(make_txns):
    """Equal payments of a day and month fall into one cell and count as often as they occur."""
    rows = [r for r in worked_example() for _ in range(3)]
    txns = make_txns(rows)
    assert combined_days(txns).count() < len(rows) and combined_activity(txns).count() < len(rows)
    for operator, cells in ((customer_profile, combined_activity), (emi_totals, combined_activity),
                            (series_ends, combined_activity), (income_sources, combined_activity),
                            (open_maturities, combined_days), (series_drift, combined_days)):
        assert unordered(operator(cells(txns))) == unordered(operator(txns))


def test_rerun_without_a_value_keeps_the_stored_row(history, spark):
    new = spark.createDataFrame([row("c1", "current_dti", 0.9, "2024-01-01")], FEATURES)
    first_day = history.where("computed_at = '2024-01-01'")
    merged = {r["feature_name"]: r["feature_value"]
              for r in store.merge_features(first_day, new).collect()}
    assert merged == {"current_dti": 0.9, "savings_ratio_6m": -0.5}


def test_as_of_takes_the_latest_value_up_to_the_day(history):
    def value(day):
        rows = store.features_as_of(history, day and dt.date.fromisoformat(day)).collect()
        return {(r["customer_id"], r["feature_name"]): r["feature_value"] for r in rows}

    assert value("2024-01-31")[("c1", "current_dti")] == 0.1
    assert value("2024-02-01")[("c1", "current_dti")] == 0.2
    assert ("c2", "current_dti") not in value("2024-02-01")
    assert value(None)[("c2", "current_dti")] == 0.3


def test_vectors_have_the_fixed_columns(history):
    vectors = store.feature_vectors(history)
    assert vectors.columns == ["customer_id", *FEATURE_NAMES]
    first = vectors.where("customer_id = 'c1'").first()
    assert (first["current_dti"], first["savings_ratio_6m"]) == (0.2, -0.5)
    assert first["num_active_emis"] is None


def test_vectors_need_one_exchange(history):
    plan = store.feature_vectors(history, dt.date(2024, 2, 1))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_warnings_flag_but_do_not_remove(history):
    rows = store.feature_warnings(history).collect()
    assert [(r["customer_id"], r["feature_name"]) for r in rows] == [("c1", "savings_ratio_6m")]


def test_as_of_read_prunes_partitions(spark, history, tmp_path):
    root = str(tmp_path)
    for day in ("2024-01-01", "2024-02-01"):
        tables.write_features(
            history.where(history.computed_at == dt.date.fromisoformat(day)), root,
            dt.date.fromisoformat(day))
    stored = tables.read(spark, root, "features", FEATURES)
    plan = store.feature_vectors(stored, dt.date(2024, 1, 15))._jdf.queryExecution().toString()
    scan = plan.split("== Physical Plan ==")[1]
    filters = scan[scan.index("PartitionFilters"):][:200]
    assert "computed_at" in filters


def test_stored_transactions_are_sorted_for_row_group_skipping(spark, make_txns, tmp_path):
    txns = make_txns(worked_example("b") + worked_example("a"))
    tables.append_transactions(txns, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/transactions/month_idx=24288").collect()
    got = [(r["merchant_category"], r["customer_id"]) for r in rows]
    assert got == sorted(got) and len(got) == 4


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_one_customer_is_read_from_a_bounded_share_of_the_log(spark, tmp_path):
    n, root = 400_000, str(tmp_path)
    log = spark.range(n).select(
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("customer_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("input_feature_hash"),
        F.timestamp_seconds("id").alias("created_at"))
    for part in log.randomSplit([0.5, 0.5], 1):
        tables.append_by_customer(part, root, "audit_log", AUDIT_LOG)
    stored = tables.read(spark, root, "audit_log", AUDIT_LOG)
    assert stored.count() == n
    mine = stored.where("customer_id = 'c123'")
    assert rows_scanned(mine) <= n / 5
    # an absent customer inside the range of names is found in no row group or few pages
    assert rows_scanned(stored.where("customer_id = 'c123x'")) <= n / 5
    want = log.where("customer_id = 'c123'").select("input_feature_hash", "created_at")
    got = mine.select("input_feature_hash", "created_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_one_hot_customer_is_spread_over_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            F.lit("hot").alias("customer_id"), F.sha2(F.col("id").cast("string"), 256).alias("input_feature_hash"))
        tables.append_by_customer(rows, str(tmp_path), "audit_log", AUDIT_LOG)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    stored = tables.read(spark, str(tmp_path), "audit_log", AUDIT_LOG)
    assert stored.count() == 60_000 and len(stored.inputFiles()) > 3


def test_kept_state_replaces_the_days_it_covers(spark, history, tmp_path):
    """As-of reads give the same rows, from one state and the days after it only."""
    root, day = str(tmp_path), dt.date.fromisoformat
    days = sorted(r[0] for r in history.select("computed_at").distinct().collect())
    for written in days:
        tables.write_features(history.where(F.col("computed_at") == F.lit(written)), root, written)

    def same(as_of):
        got = store.features_as_of(tables.read_features(spark, root, as_of), as_of).collect()
        want = store.features_as_of(tables.read(spark, root, "features", FEATURES), as_of).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))

    assert tables.feature_state(spark, root) is None
    covered = days[0] + dt.timedelta(days=1)
    assert tables.refresh_feature_state(spark, root, covered)
    assert not tables.refresh_feature_state(spark, root, covered + dt.timedelta(days=1))
    assert not tables.refresh_feature_state(spark, root, days[0] - dt.timedelta(days=1))
    assert tables.feature_state(spark, root)[1] == covered
    for as_of in [None, *days, covered, day("2030-01-01"), day("2000-01-01")]:
        same(as_of)
    # the days before the state are not read: their files may even be unreadable
    plan = tables.read_features(spark, root)._jdf.queryExecution().toString()
    scan = plan.split("== Physical Plan ==")[1]
    assert "(computed_at#" in scan and str(covered) in scan[scan.rindex("PartitionFilters"):]
    for file in (tmp_path / "features" / f"computed_at={days[0]}").glob("*.parquet"):
        file.write_bytes(b"not parquet")
    spark.catalog.clearCache()
    assert tables.read_features(spark, root, days[-1]).count() > 0


def test_state_is_given_up_when_a_day_it_covers_is_written_again(spark, history, tmp_path):
    root = str(tmp_path)
    old, new = dt.date(2024, 1, 1), dt.date(2024, 3, 1)
    first = spark.createDataFrame([row("c1", "current_dti", 0.1, "2024-01-01")], FEATURES)
    tables.write_features(first, root, old)
    tables.keep_feature_state(spark, root, dt.date(2024, 2, 1))
    # a later day leaves it, an earlier one doesn't
    tables.write_features(
        spark.createDataFrame([row("c2", "current_dti", 0.3, "2024-03-01")], FEATURES), root, new)
    assert tables.feature_state(spark, root, new) is not None
    tables.write_features(
        spark.createDataFrame([row("c1", "current_dti", 0.2, "2024-01-01")], FEATURES), root, old)
    assert tables.feature_state(spark, root, new) is None
    rows = store.features_as_of(tables.read_features(spark, root, new)).collect()
    assert {(r["customer_id"], r["feature_value"]) for r in rows} == {("c1", 0.2), ("c2", 0.3)}
    # a state whose manifest is missing was never finished
    tables.keep_feature_state(spark, root, dt.date(2024, 2, 1))
    path, _ = tables.feature_state(spark, root, new)
    for file in (tmp_path / path.split("/")[-3] / path.split("/")[-2] / "manifest").iterdir():
        file.unlink()
    assert tables.feature_state(spark, root, new) is None
