"""CSV loading: acceptance, rejection with reasons, idempotence, write order."""

import csv
import hashlib

import pytest

from tallyscope.functions.columns import month_index
from tallyscope.operators import ingest
from tallyscope.plans import ingest as jobs
from tallyscope.schemas import (
    CUSTOMERS,
    INGESTION_LOG,
    LABELS,
    STORED_TRANSACTIONS,
    TRANSACTIONS,
)
from tallyscope.sources import tables
from tallyscope.sources.csv_files import read_csv, source_files

TXN_HEADER = ["customer_id", "date", "amount", "category", "type", "merchant_category",
              "recurring_group_id"]


@pytest.fixture
def write(tmp_path):
    def write(name, header, rows):
        path = tmp_path / name
        with open(path, "w", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(header)
            writer.writerows(rows)
        return str(path)

    return write


def txn(**changes):
    row = {"customer_id": "c1", "date": "2024-01-05", "amount": "100.50", "category": "food",
           "type": "debit", "merchant_category": "dining", "recurring_group_id": ""}
    return list({**row, **changes}.values())


def checked(spark, write, rows):
    path = write("t.csv", TXN_HEADER, rows)
    return ingest.check_transactions(read_csv(spark, path, TRANSACTIONS))


@pytest.mark.parametrize(
    "changes, errors",
    [
        ({}, 0),
        ({"date": "not-a-date"}, 1),
        ({"date": "2024-1"}, 1),
        ({"date": "2024-02-30"}, 1),
        ({"date": ""}, 1),
        ({"date": "2024-01-05T00:00:00"}, 0),
        ({"date": "2024-01-05 00:00:00.000Z"}, 0),
        ({"date": "2024-01-05T10:00:00"}, 1),
        ({"amount": "abc"}, 1),
        ({"amount": "5d"}, 1),
        ({"amount": "1e3"}, 0),
        ({"amount": " 12.5 "}, 0),
        ({"type": "transfer"}, 1),
        ({"type": ""}, 1),
        ({"date": "x", "amount": "y", "type": "z"}, 3),
        ({"merchant_category": ""}, 0),
        ({"category": ""}, 0),
    ],
)
def test_transaction_contract(spark, write, changes, errors):
    assert checked(spark, write, [txn(**changes)]).first()["error_count"] == errors


def test_content_id_is_the_hash_of_the_raw_cells(spark, write):
    row = checked(spark, write, [txn(amount="100.5", merchant_category="")]).first()
    text = "c1|2024-01-05|100.50|food|debit|"
    assert row["transaction_id"] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_series_id_is_not_part_of_the_content_id(spark, write):
    rows = checked(spark, write, [txn(), txn(recurring_group_id="g")]).collect()
    assert rows[0]["transaction_id"] == rows[1]["transaction_id"]


def test_same_file_twice_keeps_the_table(spark, write, tmp_path):
    root = str(tmp_path / "lake")
    path = write("t.csv", TXN_HEADER, [txn(), txn(amount="7"), txn(amount="bad"), txn()])
    for _ in range(2):
        jobs.ingest_transactions(spark, root, path)
    assert tables.read(spark, root, "transactions", TRANSACTIONS).count() == 2
    log = tables.read(spark, root, "ingestion_log", INGESTION_LOG).collect()
    assert [(r["row_count"], r["rows_accepted"], r["rows_rejected"]) for r in log] == [(4, 3, 1)] * 2
    assert log[0]["rejection_sample"] == "Row cid=c1 date=2024-01-05: 1 validation errors"
    assert log[0]["filename"].endswith("t.csv")


def test_first_copy_wins_in_file_order(spark, write, tmp_path):
    root = str(tmp_path / "lake")
    path = write("t.csv", TXN_HEADER, [txn(recurring_group_id="z"), txn(recurring_group_id="a")])
    jobs.ingest_transactions(spark, root, path)
    again = write("u.csv", TXN_HEADER, [txn(recurring_group_id="later")])
    jobs.ingest_transactions(spark, root, again)
    rows = tables.read(spark, root, "transactions", TRANSACTIONS).collect()
    assert [r["recurring_group_id"] for r in rows] == ["z"]


def test_log_keeps_the_first_five_reasons_in_file_order(spark, write):
    rows = [txn(customer_id=f"c{9 - i}", amount="x") for i in range(8)]
    log = ingest.ingestion_log(checked(spark, write, rows)).first()
    assert log["rejection_sample"] == "; ".join(
        f"Row cid=c{9 - i} date=2024-01-05: 1 validation errors" for i in range(5)
    )
    wide = [txn(customer_id="c" * 200, amount="x")] * 5
    assert len(ingest.ingestion_log(checked(spark, write, wide)).first()["rejection_sample"]) == 500


def test_file_order_holds_across_splits(spark, write):
    """A file read in many splits still numbers its rows in file order."""
    rows = [txn(customer_id=f"c{i:05d}") for i in range(3000)]
    path = write("t.csv", TXN_HEADER, rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = read_csv(spark, path, TRANSACTIONS)
        assert raw.rdd.getNumPartitions() > 1
        got = [r["customer_id"] for r in raw.orderBy("seq").select("customer_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"c{i:05d}" for i in range(3000)]


def test_customers_upsert_last_row_wins(spark, write, tmp_path):
    root = str(tmp_path / "lake")
    header = ["customer_id", "name", "employer_tenure_months"]
    jobs.ingest_customers(spark, root, write("a.csv", header, [
        ["c1", "Old", "5"], ["c1", "New", ""], ["c2", "Bad", "five"], ["c3", "Kept", "7"]]))
    jobs.ingest_customers(spark, root, write("b.csv", ["customer_id", "name"], [["c1", "Third"]]))
    rows = tables.read_snapshot(spark, root, "customers", CUSTOMERS).orderBy("customer_id").collect()
    got = [(r["customer_id"], r["name"], r["employer_tenure_months"]) for r in rows]
    assert got == [("c1", "Third", None), ("c3", "Kept", 7)]
    assert rows[0]["city"] is None


@pytest.mark.parametrize("text, value", [
    ("True", True), (" yes ", True), ("1", True), ("false", False), ("maybe", False), ("", False)])
def test_label_texts(spark, write, text, value):
    path = write("l.csv", ["customer_id", "product", "converted"], [["c1", "home_loan", text]])
    row = ingest.check_labels(read_csv(spark, path, LABELS)).first()
    assert (row["converted"], row["error_count"]) == (value, 0)


def test_allowed_products_are_optional(spark, write, tmp_path):
    root = str(tmp_path / "lake")
    path = write("l.csv", ["customer_id", "product", "converted"],
                 [["c1", "home_loan", "1"], ["c1", "boat_loan", "1"], ["c1", "home_loan", "0"]])
    raw = read_csv(spark, path, LABELS)
    assert ingest.rejected(ingest.check_labels(raw)).count() == 0
    assert ingest.rejected(ingest.check_labels(raw, ["home_loan"])).count() == 1
    jobs.ingest_labels(spark, root, path)
    rows = tables.read_snapshot(spark, root, "labels", LABELS).collect()
    assert {(r["product"], r["converted"]) for r in rows} == {
        ("home_loan", False), ("boat_loan", True)}


def test_hot_duplicate_key_is_cut_before_the_shuffle(spark, write):
    """The rank filter runs on both sides of the exchange."""
    new = ingest.accepted(checked(spark, write, [txn()] * 50))
    plan = ingest.first_wins(new, ["transaction_id"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert ingest.first_wins(new, ["transaction_id"]).count() == 1


def test_absent_required_columns_are_errors(spark, write):
    path = write("c.csv", ["customer_id"], [["c1"]])
    assert ingest.check_customers(read_csv(spark, path, CUSTOMERS)).first()["error_count"] == 1
    path = write("l.csv", ["customer_id", "product"], [["c1", "home_loan"]])
    assert ingest.check_labels(read_csv(spark, path, LABELS)).first()["error_count"] == 1
    path = write("t.csv", TXN_HEADER[:3], [txn()[:3]])
    assert ingest.check_transactions(read_csv(spark, path, TRANSACTIONS)).first()["error_count"] == 2


def test_load_prunes_stored_months(spark, write, tmp_path):
    """A small load is compared with stored ids of its own months only."""
    root = str(tmp_path / "lake")
    path = write("t.csv", TXN_HEADER, [txn(date=f"2024-{m:02d}-05") for m in range(1, 10)])
    jobs.ingest_transactions(spark, root, path)
    stored = tables.read(spark, root, "transactions", STORED_TRANSACTIONS)
    assert stored.count() == 9
    new = ingest.accepted(checked(spark, write, [txn(), txn(amount="9")]))
    new = new.withColumn("month_idx", month_index(new.date))
    unseen = ingest.first_wins(new, ["month_idx", "transaction_id"], stored)
    assert "dynamicpruning" in unseen._jdf.queryExecution().toString()
    assert unseen.count() == 1


def test_each_file_is_read_by_its_own_header(spark, write, tmp_path):
    write("a.csv", TXN_HEADER, [txn(), txn(amount="1")])
    order = [6, 5, 0, 4, 3, 2, 1]
    write("b.csv", [TXN_HEADER[i] for i in order], [[txn(merchant_category="rent")[i] for i in order]])
    write("c.csv", TXN_HEADER[:4], [txn(amount="7")[:4]])
    write("d.csv", TXN_HEADER, [])
    raw = read_csv(spark, str(tmp_path), TRANSACTIONS)
    rows = {(r.amount, r.merchant_category, r.type, r.date, r.customer_id) for r in raw.collect()}
    assert rows == {("100.50", "dining", "debit", "2024-01-05", "c1"),
                    ("1", "dining", "debit", "2024-01-05", "c1"),
                    ("100.50", "rent", "debit", "2024-01-05", "c1"),
                    ("7", None, None, "2024-01-05", "c1")}
    log = ingest.ingestion_log(
        ingest.check_transactions(raw), files=source_files(spark, str(tmp_path))).collect()
    counts = {r.filename.rpartition("/")[2]: (r.row_count, r.rows_accepted, r.rows_rejected) for r in log}
    assert counts == {"a.csv": (2, 2, 0), "b.csv": (1, 1, 0), "c.csv": (1, 0, 1), "d.csv": (0, 0, 0)}


def test_a_small_load_rewrites_only_its_buckets(spark, tmp_path):
    root, schema = str(tmp_path), "customer_id string, name string"
    fields = spark.createDataFrame([], schema).schema

    def load(rows):
        df = spark.createDataFrame(rows, schema + ", seq int")
        tables.upsert(df, ["customer_id"], root, "people", fields, buckets=16)

    def stored():
        return {r.customer_id: r.name for r in tables.read_snapshot(spark, root, "people", fields).collect()}

    def files():
        return {str(p) for p in (tmp_path / "people/data").rglob("*.parquet")}

    load([(f"c{i}", "old", 0) for i in range(500)])
    before = files()
    load([("c1", "first", 1), ("c1", "last", 2), ("new", "n", 1), (None, "no id", 0)])
    want = {f"c{i}": "old" for i in range(500)} | {"c1": "last", "new": "n", None: "no id"}
    assert stored() == want
    fresh = files() - before
    assert before <= files() and 1 <= len({f.split("bucket=")[1].split("/")[0] for f in fresh}) <= 3
    # a load that dies before its manifest is not seen, and the next one replaces it
    spark.createDataFrame([("c2", "torn")], schema).write.parquet(
        f"{root}/people/data/version_3/bucket=0")
    assert stored() == want
    load([("c2", "whole", 5)])
    assert stored() == want | {"c2": "whole"}
    load([])
    assert stored() == want | {"c2": "whole"}


def test_a_snapshot_table_becomes_a_bucketed_one(spark, tmp_path):
    root, schema = str(tmp_path), "customer_id string, name string"
    old = spark.createDataFrame([("a", "1"), ("b", "1")], schema)
    tables.write_snapshot(old, root, "people", old.schema)
    new = spark.createDataFrame([("b", "2", 0), ("c", "2", 0)], schema + ", seq int")
    tables.upsert(new, ["customer_id"], root, "people", old.schema)
    rows = tables.read_snapshot(spark, root, "people", old.schema).collect()
    assert sorted(map(tuple, rows)) == [("a", "1"), ("b", "2"), ("c", "2")]
