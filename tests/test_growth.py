"""Queries whose work must not grow faster than their tables: what is read, written and sent once."""

import datetime as dt
import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import bill_days, mixed

from tallyscope.functions import isolation
from tallyscope.operators import billshift, capacity, store
from tallyscope.operators.base import Base
from tallyscope.operators.monthly import customer_profile
from tallyscope.plans import queries
from tallyscope.session import shared_dir, staged

DAY = dt.date(2022, 12, 1)


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few customers with orders and line items over eight years."""
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(7)
    day = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randint(0, 2500))
    orders = [(i, i % 9, rng.choice("FOP"), rng.randint(1000, 300000) / 1.0, day(), "5-LOW")
              for i in range(400)]
    lines = [(o[0], rng.randint(0, 19), rng.randint(0, 9), n, rng.randint(1, 50) * 1.0,
              rng.randint(100, 90000) / 1.0, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, day())
             for o in orders for n in range(1, 6)]
    kinds = list(queries.tt.DEBIT_MERCHANTS)
    for name, rows, schema in (
        ("customer", [(i, f"Customer#{i}", i % 25, 10.0 * i, "BUILDING") for i in range(9)],
         "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("part", [(i, kinds[i % len(kinds)]) for i in range(20)], "p_partkey long, p_type string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, "
                           "o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                            "l_quantity double, l_extendedprice double, l_discount double, "
                            "l_tax double, l_shipdate timestamp"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_forests_of_many_series_are_those_of_each():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 40, 300):
        points = np.stack([np.c_[rng.integers(1, 29, length), rng.random(length)] for _ in range(7)])
        points[0] = 5.0
        together = isolation.grow_many(points, 42)
        scores = isolation.score(together, points.reshape(-1, 2), np.repeat(np.arange(7), length))
        for i, series in enumerate(points):
            alone = isolation.grow(series, 42)
            at = slice(i * isolation.TREES, (i + 1) * isolation.TREES)
            assert all((alone[k] == together[k][at]).all() for k in ("feature", "threshold", "count"))
            assert np.array_equal(scores.reshape(7, length)[i], isolation.score(alone, series),
                                  equal_nan=True)


def test_short_series_need_no_task_group_of_their_own(make_txns, monkeypatch):
    """Series of several lengths, equal rows among them, score as if each were grown alone."""
    rows = [(f"c{c}", f"2024-{m:02d}-{min(28, 2 + m * (1 + c % 2)):02d}", 100 + m * c, *rest)
            for c in range(4) for m in range(1, 8 + c)
            for _, _, _, *rest in bill_days([1]) for _ in range(1 + (m == 7))]
    txns = make_txns(rows)
    pairs = lambda: sorted((r.customer_id, r.score) for r in billshift.series_scores(txns).collect())
    with monkeypatch.context() as patch:
        patch.setattr(billshift, "SUBSAMPLE", 0)
        alone = pairs()

    def fail(frame):
        raise AssertionError("a group for a short series")

    monkeypatch.setattr(billshift, "_grow_packed", fail)
    assert pairs() == alone and len(alone) == 4


def test_runs_of_two_days_read_one_written_base(make_txns):
    txns = make_txns(mixed())
    base = Base(txns)
    early, late = store.features_long(base.before(DAY), DAY), store.features_long(base, DAY)
    folders = {f.rsplit("/", 1)[0] for df in (early, late) for f in df.inputFiles() if "transactions-" in f}
    assert len(folders) == 1
    cut_first = store.features_long(txns.where(F.col("date") < F.lit(DAY)), DAY)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, cut_first.collect()))


def test_rows_that_few_tasks_wrote_are_read_by_many(spark):
    rows = staged(spark.range(1000).coalesce(1), rows_per_file=100)
    assert len(rows.inputFiles()) == 10 and rows.count() == 1000


def test_months_of_a_customer_are_collected_where_they_meet(make_txns):
    plan = plan_of(customer_profile(make_txns(mixed())))
    sent = plan.split("REPARTITION_BY_COL")[1]
    assert "collect_list" not in sent and "REPARTITION_BY_COL" in plan


def test_capacity_targets_need_no_second_reading(spark):
    names = [n for n in capacity.FEATURE_NAMES if n != "salary_amount_median"]
    schema = "customer_id string, salary_amount_median double, " + ", ".join(f"{n} double" for n in names)
    vectors = spark.createDataFrame(
        [("a", 900.0, *[100.0] * len(names)), ("b", 0.0, *[100.0] * len(names)),
         (None, 900.0, *[100.0] * len(names)), ("c", 900.0, *[None] * len(names))], schema)
    training = capacity.capacity_training(vectors)
    assert "Join" not in plan_of(training)
    assert {r.customer_id: r.target for r in training.collect()} == {
        "a": 800.0, "b": 0.0, None: 0.0, "c": 900.0}


def test_a_score_audit_hashes_the_whole_latest_vector(spark, tables):
    audited = {r.customer_id: r.input_feature_hash
               for r in queries.QUERIES["score_audit"](spark, tables).collect()}
    hashes = {r.customer_id: r.input_feature_hash
              for r in queries.QUERIES["feature_hash"](spark, tables).collect()}
    assert audited == hashes and len(audited) == 9


def test_arriving_rows_lie_in_files_of_several_tasks(spark, tables):
    before = set(glob.glob(f"{shared_dir(spark)}/arriving-*"))
    rows = queries.QUERIES["stream_ingest"](spark, tables).collect()
    assert rows and all(r.copies == 1 and r.replayed == 0 for r in rows)
    folder, = set(glob.glob(f"{shared_dir(spark)}/arriving-*")) - before
    assert len(glob.glob(f"{folder}/*.parquet")) > 2


def test_scores_and_vectors_of_the_lead_list_are_written_once(spark, tables):
    files = queries.stand_in_customers(spark, tables).inputFiles()
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in files} == {"customer.parquet", "wide"}
