"""Queries over large tables work on some customers, orders or months after others: what a part
shuffles and stages goes before the next, and the results are those of the whole."""

import glob
import time

import pytest
from pyspark.sql import functions as F
from test_features import mixed
from test_growth import tables  # noqa: F401

from tallyscope.functions.columns import month_index
from tallyscope.operators import ingest
from tallyscope.operators.base import Base
from tallyscope.plans import queries
from tallyscope.session import passing, shared_dir, staged, staged_in_turn


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def left_over(spark, before, wait=10):
    """Shuffle files that were not there before; Spark deletes them in the background."""
    until = time.time() + wait
    while (new := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return new


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def in_small_parts(monkeypatch):
    monkeypatch.setattr(queries.tt, "PART_ROWS", 600)
    monkeypatch.setattr(queries.tt, "SLICE_ROWS", 900)


def test_shuffle_files_of_staged_rows_go_when_they_are_written(spark):
    before = shuffle_files(spark)
    rows = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not left_over(spark, before) and rows.count() == 7


def test_what_a_part_stages_goes_before_the_next(spark):
    seen = []

    def make(part):
        assert not seen or not glob.glob(f"{seen[-1]}/*.parquet")
        own = staged(spark.range(part), "of-a-part")
        seen.append(own.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
        return own.withColumn("part", F.lit(part))

    rows = staged_in_turn(spark, [1, 2, 3], make, by=("part",))
    assert sorted(r.part for r in rows.collect()) == [1, 2, 2, 3, 3, 3]
    assert not [f for folder in seen for f in glob.glob(f"{folder}/*")]
    with passing(spark):
        kept = staged_in_turn(spark, [1], lambda n: spark.range(0), by=())
        assert kept.count() == 0 and kept.columns == ["id"]


def test_parts_of_a_base_hold_whole_customers(spark, make_txns):
    txns = make_txns([*mixed(), (None, "2022-03-01", 5, "credit", "salary", None)])
    base = Base([txns.where("customer_id is null or type = 'credit'"),
                 txns.where("customer_id is not null and type = 'debit'")], parts=3)
    parts = base.by_customers()
    found = [{r.customer_id for r in part.rows.select("customer_id").distinct().collect()}
             for part in parts]
    assert sum(map(len, found)) == len(set().union(*found)) == txns.select("customer_id").distinct().count()
    assert sum(part.rows.count() for part in parts) == base.rows.count() == txns.count()


def test_slices_of_orders_hold_every_row_once(spark, tables, in_small_parts):  # noqa: F811
    slices = queries.tt.slices(spark, tables)
    whole = rows_of(queries.tt.transactions(spark, tables))
    assert len(slices) > 1
    assert sorted(r for part in slices for r in rows_of(queries.tt.transactions(spark, tables, part))) == whole


def test_vectors_for_the_models_are_made_in_parts(spark, tables, in_small_parts):  # noqa: F811
    before, bases = shuffle_files(spark), f"{shared_dir(spark)}/transactions-*"
    written = set(glob.glob(bases))
    vectors = queries.trained_vectors(spark, f"{tables}/")
    assert not left_over(spark, before) and queries.tt.parts(spark, tables) > 1
    assert set(glob.glob(bases)) == written
    whole = queries.model_vectors(Base(queries.tt.transactions(spark, tables)))
    assert vectors.columns == whole.columns and rows_of(vectors) == rows_of(whole)


MODELS = ["model_score_records", "model_lead_audit", "reason_codes", "model_leads", "capacity_confidence"]


@pytest.mark.parametrize("name", MODELS)
def test_models_learn_from_vectors_made_in_parts(spark, tables, monkeypatch, name):  # noqa: F811
    class Reached(Exception):
        pass

    def reach(*_):
        raise Reached

    monkeypatch.setattr(queries, "feature_base", reach)
    with pytest.raises(Reached):
        queries.QUERIES[name](spark, f"{tables}/./")


def test_a_batch_is_loaded_some_months_after_others(spark, tables, in_small_parts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(queries.stream, "LOAD_ROWS", 20)
    raw = queries.tt.raw_transactions(spark, tables)
    new = ingest.accepted(ingest.check_transactions(raw)).withColumn("month_idx", month_index(F.col("date")))
    few = new.where(F.col("month_idx") < 12 * 1995 + 4)
    found = [rows_of(few.where(some)) for some in queries.stream._loads(few)]
    assert len(found) > 4 and sorted(r for rows in found for r in rows) == rows_of(few)
    # the busiest month has more rows than a load
    assert max(map(len, found)) < few.groupBy("month_idx").count().agg(F.max("count")).first()[0]

    monkeypatch.setattr(queries.stream, "LOAD_ROWS", 700)
    before = {name: set(glob.glob(f"{shared_dir(spark)}/{name}-*")) for name in ("stream", "arriving")}
    kept = shuffle_files(spark)
    rows = queries.QUERIES["stream_ingest"](spark, tables)
    assert not left_over(spark, kept)
    assert sorted((r.transaction_id, r.customer_id, r.copies, r.replayed) for r in rows.collect()) == sorted(
        (r.transaction_id, r.customer_id, 1, 0)
        for r in new.select("transaction_id", "customer_id").distinct().collect())
    assert set(glob.glob(f"{shared_dir(spark)}/stream-*")) == before["stream"]
    # only the replay's files are left of those that arrived
    arrived, = set(glob.glob(f"{shared_dir(spark)}/arriving-*")) - before["arriving"]
    assert {r.recurring_group_id for r in spark.read.parquet(arrived).collect()} == {"replayed"}


PARTED = ["features_rerun", "score_audit", "feature_hash", "feature_vectors", "capacity_matrix", "training_matrix", "debt_features", "current_dti"]


@pytest.mark.parametrize("name", PARTED)
def test_results_of_parts_are_those_of_the_whole(spark, tables, monkeypatch, name):  # noqa: F811
    if not glob.glob(f"{tables}/labels.parquet"):
        spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int").write.parquet(
            f"{tables}/labels.parquet")
    whole = rows_of(queries.QUERIES[name](spark, tables))
    monkeypatch.setattr(queries.tt, "PART_ROWS", 1200)
    monkeypatch.setattr(queries.tt, "SLICE_ROWS", 1200)
    before, made = shuffle_files(spark), []
    own = Base.by_customers
    monkeypatch.setattr(Base, "by_customers", lambda base: made.append(own(base)) or made[-1])
    found = queries.QUERIES[name](spark, tables)
    assert not left_over(spark, before) and made and {len(parts) for parts in made} == {2}
    assert rows_of(found) == whole
