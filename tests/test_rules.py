"""Gate, leads, audit and threshold rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import audit, gate, leads, thresholds
from tallyscope.plans import scoring
from tallyscope.schemas import AUDIT_LOG, CONFIG_CHANGE_LOG, THRESHOLDS
from tallyscope.sources import tables

SCORED = "customer_id string, product string, dti double, account_vintage_months int, confidence double"


def gated(spark, dti, vintage, confidence, limits=None, product="home_loan"):
    df = spark.createDataFrame([("c1", product, dti, vintage, confidence)], SCORED)
    table = limits and spark.createDataFrame(limits, THRESHOLDS)
    return gate.check_eligibility(df, table).first()


@pytest.mark.parametrize("dti, vintage, confidence, result, failures", [
    (0.5, 6, 0.3, "pass", 0),
    (0.0, 24, 0.9, "pass", 0),
    (0.51, 24, 0.9, "fail", 1),
    (0.3, 5, 0.9, "manual_review", 1),
    (0.3, 24, 0.29, "manual_review", 1),
    (0.3, 2, 0.1, "manual_review", 2),
    (0.8, 2, 0.9, "fail", 2),
    (0.8, 2, 0.1, "fail", 3),
])
def test_gate_outcomes(spark, dti, vintage, confidence, result, failures):
    row = gated(spark, dti, vintage, confidence)
    assert (row["gate_result"], len(row["rules_failed"])) == (result, failures)
    assert row["rules_checked"] == ["dti_below_0.5", "vintage_above_6m", "confidence_above_0.3"]


def test_failure_texts_in_rule_order(spark):
    assert gated(spark, 0.8, 2, 0.1)["rules_failed"] == [
        "DTI 0.8000 exceeds 0.50",
        "Account vintage 2m below 6m minimum",
        "Model confidence 0.1000 below 0.30 minimum",
    ]


@pytest.mark.parametrize("unknown", [None, float("nan")])
def test_unknown_values_fail_their_rule(spark, unknown):
    row = gated(spark, unknown, 24, 0.9)
    assert (row["gate_result"], row["rules_failed"]) == ("fail", ["DTI is unknown"])
    row = gated(spark, 0.3, 24, unknown)
    assert (row["gate_result"], row["rules_failed"]) == ("manual_review", ["Model confidence is unknown"])
    row = gated(spark, unknown, None, unknown)
    assert row["gate_result"] == "fail" and len(row["rules_failed"]) == 3
    assert gated(spark, 0.3, None, 0.9)["rules_failed"] == ["Account vintage is unknown"]


def test_product_limits_with_defaults_for_missing_ones(spark):
    limits = [("home_loan", 0.9, None, 0.05), ("auto_loan", 0.1, 1, 0.1)]
    row = gated(spark, 0.8, 6, 0.1, limits)
    assert row["gate_result"] == "pass"
    assert row["rules_checked"] == ["dti_below_0.9", "vintage_above_6m", "confidence_above_0.05"]
    assert gated(spark, 0.8, 6, 0.1, limits, "boat_loan")["gate_result"] == "fail"


def scored(spark, rows):
    schema = SCORED + ", name string, intent_score double, q50 double"
    return spark.createDataFrame(
        [(c, "home_loan", dti, 12, conf, c.upper(), score, 1234.567) for c, score, dti, conf in rows],
        schema)


def test_leads_are_filtered_and_sorted(spark):
    df = scored(spark, [("b", 70.0, 0.1, 0.9), ("a", 70.0, 0.1, 0.9), ("c", 90.0, 0.1, 0.9),
                        ("d", 95.0, 0.9, 0.9), ("e", 95.0, 0.1, 0.1), ("f", 10.0, 0.1, 0.9)])
    rows = leads.rank_leads(df, min_score=50).collect()
    assert [r["customer_id"] for r in rows] == ["c", "a", "b"]
    assert rows[0]["estimated_income"] == 1234.57 and rows[0]["gate_result"] == "pass"
    assert leads.rank_leads(df, min_score=70).count() == 3


def test_unsupported_product(spark):
    with pytest.raises(ValueError):
        leads.rank_leads(scored(spark, []), "auto_loan")


def test_customers_without_scores_are_left_out(spark):
    customers = spark.createDataFrame([("a", "A"), ("b", "B")], "customer_id string, name string")
    vectors = spark.createDataFrame(
        [("a", None, 7.9)],
        "customer_id string, current_dti double, income_source_tenure_months double")
    cap = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 0.6), ("b", 1.0, 2.0, 3.0, 0.6)],
                                "customer_id string, q10 double, q50 double, q90 double, "
                                "capacity_confidence double")
    intent = spark.createDataFrame([("a", 60.0, 0.2)],
                                   "customer_id string, intent_score double, "
                                   "intent_confidence double")
    rows = leads.scored_customers(customers, vectors, cap, intent, "home_loan").collect()
    assert len(rows) == 1
    got = rows[0]
    assert (got["dti"], got["account_vintage_months"], got["confidence"]) == (0.0, 7, 0.2)


# --- audit -------------------------------------------------------------------------------


def hashed(spark, features):
    pairs = [F.lit(x) for pair in features.items() for x in pair]
    return spark.range(1).select(audit.hash_features(F.create_map(*pairs))).first()[0]


def test_hash_ignores_key_order_and_sees_every_value(spark):
    one = hashed(spark, {"a": 1.0, "b": 2.5})
    assert len(one) == 64
    assert one == hashed(spark, {"b": 2.5, "a": 1.0})
    assert one != hashed(spark, {"a": 1.0, "b": 2.6})
    assert one != hashed(spark, {"a": 1.0})


def test_audit_trail_newest_first(spark):
    def entry(customer, second):
        return (customer, "home_loan", "1", "1", "pass", "rm", "h",
                dt.datetime(2024, 1, 1, 0, 0, second))

    log = spark.createDataFrame([entry("a", 1), entry("b", 9), entry("a", 5), entry("a", 3)],
                                AUDIT_LOG)
    got = [r["created_at"].second for r in audit.audit_trail(log, "a").collect()]
    assert got == [5, 3, 1]
    everyone = [(r["customer_id"], r["created_at"].second) for r in audit.audit_trail(log).collect()]
    assert everyone == [("a", 5), ("a", 3), ("a", 1), ("b", 9)]


def test_lead_list_audit_row(spark):
    df = leads.rank_leads(scored(spark, [("a", 70.0, 0.1, 0.9), ("b", 60.0, 0.1, 0.9)]))
    row = audit.lead_audit_row(df, "home_loan", 0.0, "rm").first()
    assert (row["customer_id"], row["gate_result"]) == ("__leads_batch__", "returned_2_leads")
    assert (row["input_feature_hash"], row["capacity_model_version"]) == ("min_score=0.0", "n/a")


# --- thresholds --------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path)
    table = spark.createDataFrame([("home_loan", 0.5, 6, 0.3)], THRESHOLDS)
    tables.write_snapshot(table, root, "gating_thresholds", THRESHOLDS)
    return root


def update(spark, root, *values, product="home_loan"):
    row = spark.createDataFrame([(product, *values)], THRESHOLDS)
    return tuple(scoring.update_thresholds(spark, root, row).first())


def changes(spark, root):
    rows = tables.read(spark, root, "config_change_log", CONFIG_CHANGE_LOG).collect()
    return sorted((r["field_name"], r["old_value"], r["new_value"]) for r in rows)


def test_partial_update_logs_only_changed_fields(spark, stored):
    assert update(spark, stored, 0.4, None, 0.3) == ("home_loan", 0.4, 6, 0.3)
    assert changes(spark, stored) == [("max_dti", "0.5", "0.4")]
    update(spark, stored, 0.4, 12, None)
    assert changes(spark, stored) == [
        ("max_dti", "0.5", "0.4"), ("min_vintage_months", "6", "12")]


def test_update_equal_to_current_logs_nothing(spark, stored):
    update(spark, stored, 0.5, 6, 0.3)
    assert changes(spark, stored) == []


@pytest.mark.parametrize("values", [
    (1.5, None, None), (-0.1, None, None), (None, 0, None), (None, -3, None), (None, None, 1.01)])
def test_out_of_range_updates_are_refused(spark, stored, values):
    with pytest.raises(ValueError):
        update(spark, stored, *values)
    assert changes(spark, stored) == []


@pytest.mark.parametrize("values", [(0.0, 1, 0.0), (1.0, None, 1.0)])
def test_range_edges_are_valid(spark, values):
    row = spark.createDataFrame([("home_loan", *values)], THRESHOLDS)
    assert thresholds.valid_updates(row).count() == 1


def test_unknown_product_is_refused(spark, stored):
    with pytest.raises(ValueError):
        update(spark, stored, 0.4, None, None, product="boat_loan")


def test_thresholds_job_changes_only_what_is_given(spark, tmp_path, capsys):
    from tallyscope.__main__ import main

    stored = spark.createDataFrame([("home_loan", 0.5, 6, 0.3), ("other", 0.5, 6, 0.3)], THRESHOLDS)
    tables.write_snapshot(stored, str(tmp_path), "gating_thresholds", THRESHOLDS)
    main(["--root", str(tmp_path), "thresholds", "--max-dti", "0.4"])
    assert "0.4" in capsys.readouterr().out
    rows = {r["product"]: tuple(r)[1:] for r in scoring.read_thresholds(spark, str(tmp_path)).collect()}
    assert rows == {"home_loan": (0.4, 6, 0.3), "other": (0.5, 6, 0.3)}
    with pytest.raises(ValueError):
        main(["--root", str(tmp_path), "thresholds", "--max-dti", "4"])
