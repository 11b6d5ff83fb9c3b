"""The registered queries: each operator over the whole supplied tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.operators import (
    audit,
    billshift,
    capacity,
    cashflow,
    debt,
    explain,
    gate,
    income,
    ingest,
    intent,
    leads,
    metrics,
    monthly,
    pooling,
    store,
    subscription,
    thresholds,
)
from tallyscope.operators.base import Base
from tallyscope.schemas import AUDIT_LOG, MODEL_VERSION, STORED_TRANSACTIONS, THRESHOLDS, TRANSACTIONS
from tallyscope.session import (
    cut,
    delete,
    passing,
    scratch_path,
    shuffles_dropped,
    staged,
    staged_in_turn,
    write_in_turn,
)
from tallyscope.sources import artifacts, tables
from tallyscope.sources import testtables as tt
from tallyscope.sources.csv_files import read_csv
from tallyscope.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The supplied customers have irregular income, so the steadiness limit is wide.
INCOME_CV = 2.5
EARLY, LATE = dt.date(1999, 1, 1), dt.date(2002, 1, 1)
PRODUCT = "home_loan"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def on_txns(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(tt.transactions(spark, sf_dir))


def feature_base(spark: SparkSession, sf_dir: str) -> Base:
    """The base of all transactions, in parts of customers that are worked on one after the other."""
    slices = [tt.transactions(spark, sf_dir, part) for part in tt.slices(spark, sf_dir)]
    return Base(slices, tt.parts(spark, sf_dir))


def in_parts(base: Base, make: Callable[[Base], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives for each part of the customers, written part by part."""
    parts = base.by_customers()
    return staged_in_turn(parts[0].rows.sparkSession, parts, make, name)


for _name, _operator in {
    "cashflow_features": cashflow.cashflow_features,
    "income_features": income.income_features,
    "salary_stats": income.salary_stats,
    "income_growth": income.income_growth,
    "minimal_features": monthly.minimal_features,
    "liquidity_pooling": pooling.liquidity_pooling,
    "bill_shift_drift": billshift.bill_shift_drift,
    "bill_shift_score": billshift.bill_shift,
    "customers_with_txns": store.customers_with_txns,
}.items():
    QUERIES[_name] = on_txns(_operator)


@query
def debt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the features need the transactions three times, so they are written once
    return in_parts(feature_base(spark, sf_dir), lambda part: debt.debt_features(part.activity), "debt")


def as_double(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}


def as_text(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("string") for n in names}


# --- transactions and ingest -------------------------------------------------------------


@query
def txn_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tt.transactions(spark, sf_dir)
    return rows.withColumns({**as_double("amount"), **as_text("date")})


def checked_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.check_transactions(tt.raw_transactions(spark, sf_dir))


@query
def ingest_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.accepted(checked_transactions(spark, sf_dir)).drop("source_file", "seq")
    return rows.withColumns({**as_double("amount"), **as_text("date")})


@query
def ingest_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected(checked_transactions(spark, sf_dir)).select(
        "customer_id", "type", "error_count", "reason"
    )


@query
def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = staged(checked_transactions(spark, sf_dir))
    return ingest.ingestion_log(checked).drop("ingested_at")


@query
def txn_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.accepted(checked_transactions(spark, sf_dir))
    return rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("copies"))


@query
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file and a replay of it with other series ids, loaded over the rows before 1996."""
    raw = tt.raw_transactions(spark, sf_dir)
    again = F.lit("replayed")
    both = raw.withColumn("_again", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns(
        {
            "recurring_group_id": F.when(F.col("_again"), again).otherwise(
                F.col("recurring_group_id")),
            "seq": F.when(F.col("_again"), F.col("seq").withField("series", again)).otherwise(
                F.col("seq")),
        }
    ).drop("_again")
    loaded = staged(ingest.accepted(ingest.check_transactions(both)))
    stored = ingest.accepted(ingest.check_transactions(raw)).where(
        F.col("date") < F.lit(dt.date(1996, 1, 1))
    )
    rows = ingest.first_wins(loaded, ["transaction_id"], stored)
    return rows.select("transaction_id", "customer_id", "recurring_group_id")


RAW_CELLS = ["customer_id", "date", "amount", "category", "type", "merchant_category",
             "recurring_group_id"]
#: Rows of a file that arrives in a stream.
ARRIVING_ROWS = 1_000_000


@query
def csv_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``ingest_accept``, written as CSV files of two headers and scanned."""
    raw, folder = tt.raw_transactions(spark, sf_dir), scratch_path(spark, "csv")
    # credits have no series, so their files lack the column; the other files have another order
    for kind, columns in (("credit", RAW_CELLS[:-1]), ("debit", RAW_CELLS[::-1])):
        raw.where(F.col("source_file") == f"{kind}.csv").select(*columns).write.csv(
            f"{folder}/{kind}", header=True, quote='"', escape='"', emptyValue="")
    rows = staged(ingest.check_transactions(read_csv(spark, f"{folder}/*", TRANSACTIONS)))
    return ingest.accepted(rows).drop("source_file", "seq").withColumns(
        {**as_double("amount"), **as_text("date")})


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw rows and a replay of them with other series ids, streamed in micro-batches into the
    stored table: every content id once, with a series id of the rows that came first."""
    folder, root = scratch_path(spark, "arriving"), scratch_path(spark, "streamed")

    def load_arrived() -> None:
        # what has arrived is one micro-batch
        stream.stream_transactions(
            stream.arriving_files(spark, folder, kind="parquet"), root, f"{root}/checkpoint"
        ).awaitTermination()

    # files of bounded size from all tasks
    raw = write_in_turn(
        spark, tt.slices(spark, sf_dir),
        lambda part: tt.raw_transactions(spark, sf_dir, part).select(*RAW_CELLS), folder, ARRIVING_ROWS)
    load_arrived()
    first = raw.inputFiles()
    write_in_turn(spark, [raw], lambda rows: rows.withColumn(
        "recurring_group_id", F.lit("replayed")), folder, ARRIVING_ROWS)
    # the stream takes a file once
    for file in first:
        delete(spark, file)
    load_arrived()
    stored = tables.read(spark, root, "transactions", STORED_TRANSACTIONS)
    with shuffles_dropped(spark):
        shares = max(1, -(-stored.count() // stream.LOAD_ROWS))
    share = F.pmod(F.xxhash64("transaction_id"), F.lit(shares))
    return staged_in_turn(
        spark, range(shares),
        lambda number: stored.where(share == number).groupBy("transaction_id").agg(
            F.count(F.lit(1)).alias("copies"),
            F.max("customer_id").alias("customer_id"),
            F.count_if(F.col("recurring_group_id") == "replayed").alias("replayed")), "loaded")


@query
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers renamed by each of their orders; the latest order is the last write."""
    stored = tt.customers(spark, sf_dir).select("customer_id", "name")
    updates = tt.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    return ingest.last_wins(updates, ["customer_id"], stored)


@query
def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customers and renames as two loads of a bucketed table, read back from it."""
    root = scratch_path(spark, "upserted")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("customer_id", "name")])
    first = tt.customers(spark, sf_dir).select(
        "customer_id", "name", F.struct(F.lit(0).alias("load")).alias("seq"))
    renames = tt.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    for load in (first, renames):
        tables.upsert(load, ["customer_id"], root, "customers", schema)
    return tables.read_buckets(spark, root, "customers", schema)


@query
def customer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer rows as text, with blank and broken integer cells."""
    table = tt.table(spark, sf_dir, "customer")
    raw = table.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("occupation"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_nationkey").cast("string")).alias(
            "employer_tenure_months"
        ),
        F.lit("").alias("city"),
        F.when(F.col("c_acctbal") > 9000, "five").otherwise(
            F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))
        ).alias("account_vintage_months"),
        F.lit(None).cast("string").alias("persona_type"),
        F.lit("customers.csv").alias("source_file"),
        F.struct("c_custkey").alias("seq"),
    )
    return ingest.check_customers(raw).drop("seq")


@query
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as text in several spellings."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    raw = tt.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("customer_id"),
        F.lit(PRODUCT).alias("product"),
        F.when(good & toxic, "TRUE").when(good, " Yes ").when(toxic, "0").otherwise("").alias(
            "converted"
        ),
        F.lit("labels.csv").alias("source_file"),
        F.struct("doc_id").alias("seq"),
    )
    return ingest.accepted(ingest.check_labels(raw)).drop("source_file", "seq")


# --- features ----------------------------------------------------------------------------


@query
def monthly_cashflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly.monthly_cashflow(tt.transactions(spark, sf_dir))
    return rows.withColumns({**as_double("credits", "debits"), **as_text("month")})


@query
def emi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt.emi_series(tt.transactions(spark, sf_dir)).select(
        "customer_id", "recurring_group_id", "payments", "on_time",
        F.round("amount_cv", 4).alias("amount_cv"),
    )


def _debt_column(name: str) -> Query:
    return lambda spark, sf_dir: in_parts(
        feature_base(spark, sf_dir),
        lambda part: debt.debt_features(part.activity).select("customer_id", name), "debt")


QUERIES["emi_punctuality"] = _debt_column("emi_punctuality_score")
QUERIES["current_dti"] = _debt_column("current_dti")
QUERIES["debt_trend"] = _debt_column("debt_trend_direction")


@query
def subscription_cleansing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscription.subscription_cleansing(tt.transactions(spark, sf_dir), INCOME_CV)


@query
def open_maturities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooling.open_maturities(tt.transactions(spark, sf_dir))
    return rows.select(
        "customer_id", F.col("matured").cast("string").alias("matured"),
        F.col("largest").cast("double").alias("largest"),
    )


# --- feature store -----------------------------------------------------------------------


def groups(*names: str) -> dict[str, store.FeatureGroup]:
    registry = store.feature_groups(INCOME_CV)
    return {name: registry[name] for name in names}


EXACT = ["income", "cashflow", "debt", "subscription_cleansing", "liquidity_pooling"]


@query
def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five groups that SQL can check."""
    rows = store.features_long(tt.transactions(spark, sf_dir), LATE, groups(*EXACT))
    return rows.withColumns(as_text("computed_at"))


@query
def nightly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six groups."""
    return store.features_long(
        tt.transactions(spark, sf_dir), LATE, store.feature_groups(INCOME_CV)
    )


@query
def nightly_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of a nightly run that SQL can check, one by one: what each of them stored."""
    _, outcomes = store.features_by_group(tt.transactions(spark, sf_dir), LATE, groups(*EXACT))
    return outcomes.select("group_name", "state", "features")


def feature_history(spark: SparkSession, sf_dir: str, base: Base | None = None) -> DataFrame:
    """Features as two runs would have left them: one at the start of 1999, one at the end. Both
    read one base."""
    base = Base(tt.transactions(spark, sf_dir)) if base is None else base
    early = store.features_long(base.before(EARLY), EARLY, groups(*EXACT))
    return early.unionByName(store.features_long(base, LATE, groups(*EXACT)))


@query
def features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.features_as_of(feature_history(spark, sf_dir), dt.date(2000, 1, 1))
    return rows.withColumns(as_text("computed_at"))


@query
def features_asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history read from a kept state and the days after it."""
    root = scratch_path(spark, "features-asof")
    history = feature_history(spark, sf_dir)
    tables.write_features(history.where(F.col("computed_at") == F.lit(EARLY)), root, EARLY)
    tables.keep_feature_state(spark, root, LATE - dt.timedelta(days=1))
    tables.write_features(history.where(F.col("computed_at") == F.lit(LATE)), root, LATE)
    rows = store.features_as_of(tables.read_features(spark, root, LATE))
    return rows.withColumns(as_text("computed_at"))


def latest_vectors(spark: SparkSession, sf_dir: str, base: Base | None = None) -> DataFrame:
    """The latest features of every customer; the history is made and read part by part."""
    names = [n for g in EXACT for n in store.feature_groups()[g][1]()]
    base = feature_base(spark, sf_dir) if base is None else base
    return in_parts(base, lambda part: store.feature_vectors(
        feature_history(spark, sf_dir, part), names=names), "latest")


QUERIES["feature_vectors"] = latest_vectors


@query
def feature_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.features_long(tt.transactions(spark, sf_dir), LATE, groups(*EXACT))
    return store.feature_warnings(rows)


@query
def features_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging a day's run into a table that already holds it adds no rows."""
    kinds = ["feature_name", "computed_at"]

    def rerun(part: Base) -> DataFrame:
        history = feature_history(spark, sf_dir, part)
        # the merge reads the new rows twice
        again = staged(store.features_long(part, LATE, groups(*EXACT)), "again")
        return store.merge_features(history, again).groupBy(*kinds).agg(
            F.count(F.lit(1)).alias("n"))

    counts = in_parts(feature_base(spark, sf_dir), rerun, "rerun")
    return counts.groupBy(*kinds).agg(F.sum("n").alias("n")).withColumns(as_text("computed_at"))


# --- rules and leads ---------------------------------------------------------------------


def stand_in_scores(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Simple formulas in the place of both models, so that SQL can check the lead list."""
    middle = F.col("avg_monthly_income") - F.col("avg_monthly_outflow")
    steady = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("expense_volatility") / 2.5))
    growth = F.coalesce("income_growth_pct", F.lit(0.0))
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + growth / 5))
    capacity_scores = wide.select(
        "customer_id",
        (middle - 1000).alias("q10"),
        middle.alias("q50"),
        (middle + 1000).alias("q90"),
        F.round(steady, 4).alias("capacity_confidence"),
    )
    intent_scores_ = wide.select(
        "customer_id",
        F.round(chance * 100, 2).alias("intent_score"),
        F.round(F.abs(chance - 0.5) * 2, 4).alias("intent_confidence"),
    )
    return capacity_scores, intent_scores_


def stand_in_customers(spark: SparkSession, sf_dir: str, base: Base | None = None) -> DataFrame:
    base = feature_base(spark, sf_dir) if base is None else base
    # written once: the vectors and both scores are read from it
    wide = in_parts(
        base, lambda part: store.features_wide(part, groups("income", "cashflow", "debt")), "wide")
    capacity_scores, intent_scores_ = stand_in_scores(wide)
    return leads.scored_customers(
        tt.customers(spark, sf_dir).select("customer_id", "name"), wide, capacity_scores,
        intent_scores_, PRODUCT,
    )


@query
def eligibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.check_eligibility(stand_in_customers(spark, sf_dir)).select(
        "customer_id", "dti", "account_vintage_months", "confidence", "gate_result",
        F.array_join("rules_checked", "; ").alias("rules_checked"),
        F.array_join("rules_failed", "; ").alias("rules_failed"),
    )


@query
def gate_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers gated by the limits of the product they are scored for; one product has no
    limits of its own, and some customers lack a value."""
    region = tt.table(spark, sf_dir, "region")
    limits = region.where("r_regionkey < 4").select(
        F.concat(F.lit("loan_"), F.col("r_regionkey").cast("string")).alias("product"),
        (F.col("r_regionkey") * 0.2).alias("max_dti"),
        F.when(F.col("r_regionkey") != 2, F.col("r_regionkey") * 10 + 1).cast("int").alias(
            "min_vintage_months"),
        (F.col("r_regionkey") * 0.25).alias("min_confidence"),
    )
    number = F.col("customer_id").cast("long")
    scored = stand_in_customers(spark, sf_dir).withColumns({
        "product": F.concat(F.lit("loan_"), (number % 5).cast("string")),
        "dti": F.when(number % 7 != 0, F.col("dti")),
        "confidence": F.when(number % 11 != 0, F.col("confidence")),
        "account_vintage_months": F.when(number % 13 != 0, F.col("account_vintage_months")),
    })
    return gate.check_eligibility(scored, limits).select(
        "customer_id", "product", "gate_result",
        F.array_join("rules_checked", "; ").alias("rules_checked"),
        F.size("rules_failed").alias("failures"),
        F.array_join(F.filter("rules_failed", lambda r: r.endswith("unknown")), "; ").alias("unknown"),
    )


@query
def trivial_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.trivial_score(cashflow.cashflow_features(tt.transactions(spark, sf_dir)))


@query
def lead_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sort by score reads its rows twice, so they are scored and written first
    scored = staged(stand_in_customers(spark, sf_dir), "scored")
    return leads.with_rank(leads.rank_leads(scored, PRODUCT, min_score=20.0))


@query
def customers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.customers_list(tt.customers(spark, sf_dir))


# --- audit and configuration -------------------------------------------------------------


@query
def feature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.feature_hashes(latest_vectors(spark, sf_dir))


@query
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per scored customer, with the hash of the latest vector in the store."""
    base = feature_base(spark, sf_dir)
    gated = gate.check_eligibility(stand_in_customers(spark, sf_dir, base))
    hashes = audit.feature_hashes(latest_vectors(spark, sf_dir, base))
    return audit.score_audit_rows(gated, hashes, "rm").drop("created_at")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as audit rows."""
    return tt.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.lit(PRODUCT).alias("product"),
        F.lit("0.1.0").alias("capacity_model_version"),
        F.lit("0.1.0").alias("intent_model_version"),
        F.col("event_type").alias("gate_result"),
        F.lit("rm").alias("requesting_role"),
        F.sha2("props", 256).alias("input_feature_hash"),
        F.col("ts").alias("created_at"),
    )


@query
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows, newest first within each customer."""
    return audit.audit_trail(event_log(spark, sf_dir))


@query
def audit_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored audit rows of the customer with most of them, newest first.

    The log is written clustered by customer; the read finds the customer's rows in it.
    """
    root = scratch_path(spark, "audit")
    tables.append_by_customer(event_log(spark, sf_dir), root, "audit_log", AUDIT_LOG)
    log = tables.read(spark, root, "audit_log", AUDIT_LOG)
    counts = log.where("customer_id is not null").groupBy("customer_id").count()
    busiest = counts.orderBy(F.col("count").desc(), "customer_id").first()
    return audit.audit_trail(log, busiest["customer_id"] if busiest else "")


@query
def lead_audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lead_ranking(spark, sf_dir)
    return audit.lead_audit_row(ranked, PRODUCT, 20.0, "rm").drop("created_at")


def threshold_updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers read as products: stored limits and partial updates, some out of range."""
    supplier = tt.table(spark, sf_dir, "supplier")
    current = supplier.select(
        F.col("s_name").alias("product"),
        F.lit(0.5).alias("max_dti"),
        F.lit(6).alias("min_vintage_months"),
        F.lit(0.3).alias("min_confidence"),
    )
    updates = supplier.select(
        F.col("s_name").alias("product"),
        (F.round(F.col("s_acctbal") / 8000, 2) + 0.0).alias("max_dti"),
        F.when(F.col("s_nationkey") > 4, F.col("s_nationkey") - 5).alias("min_vintage_months"),
        F.when(F.col("s_acctbal") > 5000, F.lit(0.3)).alias("min_confidence"),
    )
    return current, updates


@query
def threshold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, updates = threshold_updates(spark, sf_dir)
    return thresholds.validate_updates(updates).withColumn(
        "errors", F.array_join("errors", "; ")
    )


@query
def threshold_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, updates = threshold_updates(spark, sf_dir)
    valid = thresholds.valid_updates(updates)
    return thresholds.threshold_changes(current, valid, "admin").drop("created_at")


@query
def threshold_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, updates = threshold_updates(spark, sf_dir)
    return thresholds.apply_updates(current, thresholds.valid_updates(updates))


# --- training data and metrics -----------------------------------------------------------


@query
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.intent_training(
        latest_vectors(spark, sf_dir), tt.labels(spark, sf_dir), PRODUCT
    )


@query
def capacity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.capacity_training(latest_vectors(spark, sf_dir))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length as a score."""
    documents = tt.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tt.table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        "doc_id",
        "quality",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.col("quality") * 500.0 + 1000.0).alias("guess"),
        (F.col("quality") * 200.0 + 100.0).alias("low"),
        (F.col("quality") * 1000.0 + 2000.0).alias("high"),
    )


@query
def metric_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_absolute_error(scored_documents(spark, sf_dir), "n_chars", "guess")


@query
def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval_coverage(scored_documents(spark, sf_dir), "n_chars", "low", "high")


@query
def metric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored_documents(spark, sf_dir), "quality", "n_chars")


@query
def metric_precision_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_at_top(
        scored_documents(spark, sf_dir), "quality", "n_chars", "doc_id"
    )


# --- models ------------------------------------------------------------------------------


def model_vectors(base: Base) -> DataFrame:
    """All 20 features of all customers."""
    wide = store.features_wide(base, store.feature_groups(INCOME_CV))
    return wide.drop(*[c for c in wide.columns if c.startswith("_completeness")])


# models and vectors of one session and table folder, by application, folder and model
_TRAINED: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], object]) -> str:
    """The path of something that the session has made once for these tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TRAINED:
        path = scratch_path(spark, name)
        make(path)
        _TRAINED[key] = path
    return _TRAINED[key]


def trained_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(path: str) -> None:
        with passing(spark):  # the base goes when the vectors are written
            # small rows end up in few tasks; files of some thousand rows spread what reads them
            write_in_turn(spark, feature_base(spark, sf_dir).by_customers(), model_vectors, path,
                          rows_per_file=10_000)

    path = _once(spark, sf_dir, "vectors", make)
    return spark.read.parquet(path)


def capacity_model(spark: SparkSession, sf_dir: str) -> capacity.CapacityModel:
    path = _once(spark, sf_dir, "capacity",
                 lambda p: capacity.train_capacity(trained_vectors(spark, sf_dir), p))
    return capacity.load_capacity(spark, path)


def intent_path(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "intent", lambda p: intent.train_intent(
        trained_vectors(spark, sf_dir), tt.labels(spark, sf_dir), PRODUCT, p))


@query
def capacity_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = capacity_model(spark, sf_dir).predict(trained_vectors(spark, sf_dir))
    return scored.select("customer_id", "q10", "q50", "q90")


@query
def capacity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = capacity_model(spark, sf_dir).predict(trained_vectors(spark, sf_dir))
    return scored.select("customer_id", "capacity_confidence")


@query
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = intent.load_intent(spark, intent_path(spark, sf_dir))
    return model.predict(trained_vectors(spark, sf_dir))


@query
def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = intent_path(spark, sf_dir)
    model = intent.load_intent(spark, path)
    codes = explain.explain(
        spark, trained_vectors(spark, sf_dir), model.names, f"{artifacts.latest(spark, path)}/base", model.base)
    return codes.select("customer_id", F.inline("reason_codes"))


def model_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers scored by the trained models and gated."""
    vectors = trained_vectors(spark, sf_dir)
    scored = leads.scored_customers(
        tt.customers(spark, sf_dir).select("customer_id", "name"), vectors,
        capacity_model(spark, sf_dir).predict(vectors),
        intent.load_intent(spark, intent_path(spark, sf_dir)).predict(vectors), PRODUCT,
    )
    # labels of the supplied tables have no relation to the features: wide limits leave a list
    limits = spark.createDataFrame([(PRODUCT, 1.0, 1, 0.0)], THRESHOLDS)
    return gate.check_eligibility(scored, limits)


def listed_by_models(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    # the sort by score reads its rows twice, so they are scored and written first
    scored = staged(model_scored(spark, sf_dir), "scored") if scored is None else scored
    return cut(leads.list_leads(scored))


@query
def model_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained models, gate, ranked leads."""
    return leads.with_rank(listed_by_models(spark, sf_dir))


@query
def model_lead_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of that list, and one of every customer scored for it."""
    scored = staged(model_scored(spark, sf_dir), "scored")
    batch = audit.lead_audit_row(listed_by_models(spark, sf_dir, scored), PRODUCT, 0.0, "rm")
    hashes = audit.feature_hashes(trained_vectors(spark, sf_dir))
    rows = audit.score_audit_rows(scored, hashes, "rm")
    return batch.unionByName(rows).drop("created_at")


@query
def model_score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested score record of every customer, as JSON text."""
    path = intent_path(spark, sf_dir)
    model = intent.load_intent(spark, path)
    reasons = explain.explain(
        spark, trained_vectors(spark, sf_dir), model.names, f"{artifacts.latest(spark, path)}/base", model.base)
    records = leads.score_envelope(model_scored(spark, sf_dir), reasons, MODEL_VERSION)
    return records.select("customer_id", F.to_json(F.struct(*records.columns)).alias("record"))


# --- the deterministic ends of the models, over given numbers ------------------------------


def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as customers with a middle value and a probability."""
    return tt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("customer_id"),
        (F.col("o_totalprice") - 100000.0).alias("q50"),
        ((F.col("o_orderkey") % 1000) / 999.0).alias("probability"),
        (F.col("o_custkey") % 100).cast("double").alias("width"),
    )


@query
def confidence_of_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_numbers(spark, sf_dir).withColumns({
        "q10": F.col("q50") - F.col("width") * 700, "q90": F.col("q50") + F.col("width") * 900})
    return rows.select("customer_id",
                       capacity.interval_confidence().alias("capacity_confidence"))


@query
def forest_quantiles_of_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled quantiles over given leaves: line items are the training rows of seven trees of four
    leaves, one tree per line number, with their quantities as targets; orders are scored."""
    trees, leaves = 7, 4
    lines = tt.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") <= trees)
    fitted = lines.select(F.col("l_quantity").cast("double").alias("target"), F.array(*[
        (F.col("l_suppkey") + t * F.col("l_linenumber")) % leaves for t in range(trees)]).alias("leaf"))
    # all different quantities, at most fifty
    grid = sorted(r[0] for r in fitted.select("target").distinct().collect())
    rows = capacity.leaf_weights(fitted, grid).collect()
    orders = tt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("customer_id"),
        F.array(*[(F.col("o_custkey") + t) % leaves for t in range(trees)]).alias("leaf"))
    return capacity.pooled_quantiles(orders, capacity.LeafWeights.of_rows([tuple(r) for r in rows]))


@query
def scores_of_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.scores_of(order_numbers(spark, sf_dir))


@query
def reasons_of_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top reasons of line items whose numbers stand for contributions."""
    names = ["current_dti", "avg_monthly_income", "liquidity_buffer", "num_active_emis",
             "savings_ratio_6m", "expense_volatility", "some_other_feature"]
    lines = tt.table(spark, sf_dir, "lineitem")
    shap = lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("customer_id"),
        F.array(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, F.col("l_quantity") / 100.0,
                F.lit(0.0), -F.round("l_extendedprice") / 100000.0, (F.col("l_partkey") % 3) - 1.0,
                (F.col("l_suppkey") % 7) / 10.0).alias("shap"),
    )
    return explain.reason_codes(shap, names).select("customer_id", F.inline("reason_codes"))
