"""Training, lead scoring, audit rows and threshold changes over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyscope.operators import audit, explain, leads, thresholds
from tallyscope.operators.capacity import load_capacity, train_capacity
from tallyscope.operators.gate import check_eligibility
from tallyscope.operators.intent import load_intent, train_intent
from tallyscope.plans.nightly import load_vectors
from tallyscope.schemas import (
    AUDIT_LOG,
    CONFIG_CHANGE_LOG,
    CUSTOMERS,
    LABELS,
    LEADS,
    MODEL_VERSION,
    THRESHOLDS,
)
from tallyscope.session import cut
from tallyscope.sources import artifacts, tables


def train_models(spark: SparkSession, root: str, product: str = "home_loan") -> dict[str, dict]:
    """Train both models from the stored features and labels."""
    vectors = cut(load_vectors(spark, root))
    labels = tables.read_snapshot(spark, root, "labels", LABELS)
    if labels is None:
        raise ValueError("no labels were ingested")
    return {
        "capacity": train_capacity(vectors, f"{root}/models/capacity"),
        "intent": train_intent(vectors, labels, product, f"{root}/models/intent_{product}"),
    }


def gated_customers(
    spark: SparkSession, root: str, product: str = "home_loan",
    vintage_col: str = "income_source_tenure_months",
) -> tuple[DataFrame, DataFrame]:
    """All scored customers with their gate result, and the vectors they were scored on."""
    leads.require_supported(product)
    capacity = load_capacity(spark, f"{root}/models/capacity")
    intent = load_intent(spark, f"{root}/models/intent_{product}")
    customers = tables.read_snapshot(spark, root, "customers", CUSTOMERS)
    if capacity is None or intent is None or customers is None:
        raise RuntimeError("train the models and ingest customers first")
    vectors = cut(load_vectors(spark, root))
    scored = leads.scored_customers(
        customers, vectors, capacity.predict(vectors), intent.predict(vectors), product,
        vintage_col,
    )
    return cut(check_eligibility(scored, read_thresholds(spark, root))), vectors


def run_leads(
    spark: SparkSession, root: str, product: str = "home_loan", min_score: float = 0.0,
    role: str = "rm", audit_scores: bool = False,
) -> DataFrame:
    """Score everyone once, store the ranked leads, and audit the list.

    ``audit_scores`` also logs a row per scored customer; it is off, so that refreshing a list
    doesn't flood the log.
    """
    gated, vectors = gated_customers(spark, root, product)
    table = f"leads_{product}"
    tables.write_snapshot(leads.list_leads(gated, min_score), root, table, LEADS)
    stored = read_leads(spark, root, product)
    if audit_scores:
        versions = [
            artifacts.load_manifest(spark, f"{root}/models/{name}")["model_version"]
            for name in ("capacity", f"intent_{product}")
        ]
        rows = audit.score_audit_rows(gated, audit.feature_hashes(vectors), role, *versions)
        tables.append_by_customer(rows, root, "audit_log", AUDIT_LOG)
    batch = audit.lead_audit_row(stored, product, min_score, role)
    tables.append(batch, root, "audit_log", AUDIT_LOG)
    return stored


def read_leads(spark: SparkSession, root: str, product: str = "home_loan") -> DataFrame:
    """The stored leads in rank order."""
    stored = tables.read_snapshot(spark, root, f"leads_{product}", LEADS)
    if stored is None:
        raise RuntimeError("no leads are stored")
    return stored.orderBy(stored.intent_score.desc(), stored.customer_id)


def score_records(spark: SparkSession, root: str, product: str = "home_loan") -> DataFrame:
    """The nested score record of every customer, with reason codes for the intent score."""
    gated, vectors = gated_customers(spark, root, product)
    path = f"{root}/models/intent_{product}"
    model = load_intent(spark, path)
    base = f"{artifacts.latest(spark, path)}/base"
    reasons = explain.explain(spark, vectors, model.names, base, model.base)
    return leads.score_envelope(gated, reasons, MODEL_VERSION)


def read_thresholds(spark: SparkSession, root: str) -> DataFrame | None:
    return tables.read_snapshot(spark, root, "gating_thresholds", THRESHOLDS)


def update_thresholds(
    spark: SparkSession, root: str, updates: DataFrame, role: str = "admin"
) -> DataFrame:
    """Apply valid partial updates and log each changed field.

    An update for an unknown product, or one outside its range, is an error and changes
    nothing.
    """
    current = read_thresholds(spark, root)
    if current is None:
        raise ValueError("no thresholds are stored")
    if not thresholds.unknown_products(current, updates).isEmpty():
        raise ValueError("an update names a product without thresholds")
    if thresholds.valid_updates(updates).count() != updates.count():
        raise ValueError("an update is outside its range")
    # taken before the table changes, logged after: no change is logged that did not happen
    changes = cut(thresholds.threshold_changes(current, updates, role))
    tables.write_snapshot(
        thresholds.apply_updates(current, updates), root, "gating_thresholds", THRESHOLDS
    )
    tables.append(changes, root, "config_change_log", CONFIG_CHANGE_LOG)
    return read_thresholds(spark, root)
