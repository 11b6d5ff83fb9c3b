"""Hand-computed feature values, boundary cases and order independence."""

import datetime as dt
import random

import pytest

from tallyscope.operators import billshift, monthly, pooling, store, subscription

SALARY = [70000, 71000, 69000, 72000]


def worked_example(customer="c1"):
    rows = []
    for month, salary in enumerate(SALARY, start=1):
        rows.append((customer, f"2024-{month:02d}-01", salary, "credit", "salary", "sal_1"))
        rows.append((customer, f"2024-{month:02d}-05", 20000, "debit", "rent", "rent_1"))
    return rows


EXPECTED = {
    "salary_variance_12m": 0.0183,
    "salary_amount_median": 70500.0,
    "income_growth_pct": 0.5674,
    "num_income_sources": 1.0,
    "income_source_tenure_months": 3.2,
    "avg_monthly_income": 70500.0,
    "avg_monthly_outflow": 20000.0,
    "savings_ratio_6m": 0.7163,
    "liquidity_buffer": 49000.0,
    "expense_volatility": 0.0,
    "emi_punctuality_score": 1.0,
    "current_dti": 0.2817,
    "debt_trend_direction": 0.0,
    "num_active_emis": 1.0,
    "subscription_cleansing_flag": 0.0,
    "subscription_cleansing_score": 0.0,
    "liquidity_pooling_flag": 0.0,
    "liquidity_pooling_score": 0.0,
    "bill_shift_flag": 0.0,
    "bill_shift_score": 0.0,
}


def test_worked_example(make_txns, features_of):
    got = features_of(make_txns(worked_example()))
    assert {name: got[name] for name in EXPECTED} == EXPECTED
    for group in ("income", "cashflow", "debt"):
        assert got[f"_completeness_{group}"] == 0.3333
    assert got["_completeness_bill_shift"] == 1.0


def test_worked_example_has_twenty_rows(make_txns):
    rows = store.features_long(make_txns(worked_example()), dt.date(2024, 5, 1)).collect()
    assert len(rows) == 20
    assert {r["feature_name"]: r["feature_value"] for r in rows} == EXPECTED


def test_two_months_have_no_trend(make_txns, features_of):
    got = features_of(make_txns(worked_example()[:4]))
    assert got["income_growth_pct"] is None
    assert got["debt_trend_direction"] is None
    assert got["_completeness_income"] == 0.1667


def test_customer_without_credits(make_txns, features_of):
    rows = [("c1", f"2024-{m:02d}-10", 100 + m, "debit", "fuel", None) for m in range(1, 5)]
    got = features_of(make_txns(rows))
    assert got["salary_variance_12m"] is None and got["income_growth_pct"] is None
    assert got["num_income_sources"] == 0 and got["salary_amount_median"] == 0.0
    assert got["income_source_tenure_months"] == 0.0
    assert got["current_dti"] == 0.0 and got["savings_ratio_6m"] == 0.0


def test_customer_without_debits(make_txns, features_of):
    rows = [("c1", f"2024-{m:02d}-10", 100, "credit", "salary", None) for m in range(1, 5)]
    got = features_of(make_txns(rows))
    assert got["emi_punctuality_score"] is None and got["debt_trend_direction"] is None
    assert got["current_dti"] == 0.0 and got["num_active_emis"] == 0.0
    assert got["salary_variance_12m"] == 0.0


def test_gap_months_are_filled_with_zero(make_txns):
    txns = make_txns([
        ("c1", "2023-11-10", 10, "credit", None, None),
        ("c1", "2024-02-10", 4, "debit", None, None),
    ])
    rows = sorted(monthly.monthly_cashflow(txns).collect(), key=lambda r: r["month"])
    assert [(str(r["month"]), float(r["credits"]), float(r["debits"])) for r in rows] == [
        ("2023-11-01", 10.0, 0.0), ("2023-12-01", 0.0, 0.0),
        ("2024-01-01", 0.0, 0.0), ("2024-02-01", 0.0, 4.0),
    ]


def test_months_of_different_count_in_debt(make_txns, features_of):
    """Two active months in a four-month span: the window is two, the trend has no value."""
    rows = [
        ("c1", "2024-01-01", 1000, "credit", "salary", None),
        ("c1", "2024-04-01", 1000, "credit", "salary", None),
        *[("c1", f"2024-04-0{d}", 100, "debit", "rent", "r") for d in (1, 2, 9)],
    ]
    got = features_of(make_txns(rows))
    assert got["current_dti"] == 0.3
    assert got["emi_punctuality_score"] == 0.6667
    assert got["debt_trend_direction"] is None


def test_short_debit_span_with_long_history_has_zero_trend(make_txns, features_of):
    rows = [("c1", f"2024-0{m}-01", 1000, "credit", "salary", None) for m in (1, 2, 3, 4)]
    rows += [("c1", "2024-04-02", 100, "debit", "fuel", None)]
    assert features_of(make_txns(rows))["debt_trend_direction"] == 0.0


# --- subscription cleansing --------------------------------------------------------------


def subscriptions(last_days, kept=0):
    rows = [("c1", f"2024-{m:02d}-01", 5000, "credit", "salary", None) for m in range(1, 13)]
    for i, last in enumerate(last_days):
        end = dt.date.fromisoformat(last)
        for back in (60, 30, 0):
            day = (end - dt.timedelta(days=back)).isoformat()
            rows.append(("c1", day, 10 + i, "debit", "dining", f"s{i}"))
    for i in range(kept):
        rows += [("c1", f"2024-{m}-28", 9, "debit", "travel", f"k{i}") for m in (10, 11, 12)]
    return rows


def flag(make_txns, rows, **options):
    row = subscription.subscription_cleansing(make_txns(rows), **options).first()
    return row["subscription_cleansing_flag"], row["subscription_cleansing_score"]


def test_three_stops_within_sixty_days(make_txns):
    rows = subscriptions(["2024-06-01", "2024-07-01", "2024-07-31"], kept=1)
    assert flag(make_txns, rows) == (1.0, 0.75)


def test_stops_spread_wider_than_sixty_days(make_txns):
    assert flag(make_txns, subscriptions(["2024-06-01", "2024-07-01", "2024-08-01"]))[0] == 0.0


def test_three_stops_on_one_day(make_txns):
    assert flag(make_txns, subscriptions(["2024-06-01"] * 3)) == (1.0, 1.0)


def test_recent_end_is_not_a_stop(make_txns):
    """The data ends on 1 December; 1 November is 30 days before, 2 November is 29."""
    assert flag(make_txns, subscriptions(["2024-11-01"] * 3))[0] == 1.0
    assert flag(make_txns, subscriptions(["2024-11-01", "2024-11-01", "2024-11-02"]))[0] == 0.0


def test_unsteady_income_blocks_the_flag(make_txns):
    rows = subscriptions(["2024-06-01"] * 3)
    rows = [r for r in rows if r[3] == "debit" or r[1] in ("2024-01-01", "2024-12-01")]
    assert flag(make_txns, rows)[0] == 0.0
    assert flag(make_txns, rows, max_income_cv=5.0)[0] == 1.0


# --- liquidity pooling -------------------------------------------------------------------


def maturity(gap, amount=1000):
    day = (dt.date(2024, 3, 1) + dt.timedelta(days=gap)).isoformat()
    return [
        ("c1", "2024-03-01", amount, "credit", "investment", None),
        ("c1", day, 50, "debit", "investment", None),
        *[("c1", "2024-01-01", 100, "debit", "fuel", None)] * 5,
        ("c1", "2024-12-31", 100, "debit", "fuel", None),
    ]


def pooled(make_txns, rows):
    row = pooling.liquidity_pooling(make_txns(rows)).first()
    return row["liquidity_pooling_flag"], row["liquidity_pooling_score"]


def test_reinvestment_window_edges(make_txns):
    assert pooled(make_txns, maturity(45)) == (0.0, 0.0)
    assert pooled(make_txns, maturity(46)) == (1.0, 1.0)
    assert pooled(make_txns, maturity(0)) == (1.0, 1.0)


def test_maturity_size_edge(make_txns):
    assert pooled(make_txns, maturity(60, amount=500))[0] == 1.0
    assert pooled(make_txns, maturity(60, amount=499.99))[0] == 0.0


def test_pooling_score_counts_days_to_the_end(make_txns):
    rows = [r for r in maturity(60) if r[1] < "2024-03-02"]
    rows.append(("c1", "2024-03-31", 100, "debit", "fuel", None))
    assert pooled(make_txns, rows) == (1.0, 0.3333)


# --- bill shift --------------------------------------------------------------------------


def bill_days(days, customer="c1", series="u1", amount=50):
    return [
        (customer, f"{2023 + i // 12}-{i % 12 + 1:02d}-{d:02d}", amount + i, "debit", "utility",
         series)
        for i, d in enumerate(days)
    ]


def test_steady_bill_day(make_txns):
    row = billshift.bill_shift(make_txns(bill_days([10] * 12))).first()
    assert (row["bill_shift_flag"], row["bill_shift_score"]) == (0.0, 0.0)


def test_drifting_bill_day(make_txns):
    txns = make_txns(bill_days([5, 6, 5, 7, 9, 11, 13, 15, 17, 18, 19, 20]))
    drift = billshift.bill_shift_drift(txns).first()
    assert drift["drifting_series"] == 1 and drift["bills"] == 12
    row = billshift.bill_shift(txns).first()
    assert row["bill_shift_flag"] == 1.0 and 0.4 < row["bill_shift_score"] <= 1.0


def test_five_bills_are_too_few(make_txns):
    assert billshift.bill_shift(make_txns(bill_days([1, 1, 20, 20, 20]))).first()[
        "bill_shift_flag"
    ] == 0.0


def test_odd_length_halves(make_txns):
    """Seven rows split into three and four."""
    txns = make_txns(bill_days([1, 1, 1, 7, 7, 7, 7]))
    assert billshift.series_drift(txns).first()["drift"] == 6.0


def outlier_bills():
    rng = random.Random(3)
    days = [rng.randint(3, 6) for _ in range(60)] + [rng.randint(18, 22) for _ in range(59)] + [28]
    rows = bill_days(days)
    rows[-1] = (*rows[-1][:2], 90000, *rows[-1][3:])
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 7, 30, 10**6])
def test_chunks_of_any_size_give_the_same_scores(make_txns, chunk_rows):
    txns = make_txns(outlier_bills())
    whole = billshift.series_scores(txns).first()["score"]
    assert 0.4 < whole <= 1.0
    split = billshift.series_scores(txns, chunk_rows=chunk_rows).first()["score"]
    assert split == pytest.approx(whole, abs=1e-9)


def test_the_middle_day_is_split(make_txns):
    """All rows on few days: the cut falls inside a day."""
    rows = [("c1", "2024-01-02", 10 + i, "debit", "rent", "r") for i in range(10)]
    rows += [("c1", "2024-02-20", 50 + i, "debit", "rent", "r") for i in range(30)]
    rows += [("c1", "2024-03-25", 500 + i, "debit", "rent", "r") for i in range(10)]
    txns = make_txns(rows)
    assert billshift.series_drift(txns).first()["drift"] > 3
    whole = billshift.series_scores(txns).first()["score"]
    split = billshift.series_scores(txns, chunk_rows=9).first()["score"]
    assert split == pytest.approx(whole, abs=1e-9)


def test_a_series_longer_than_its_forest_sees(make_txns, monkeypatch):
    """The sample is a part of a long series, every row is scored, and row order is no matter."""
    monkeypatch.setattr(billshift, "FOREST_ROWS", 40)
    rows = outlier_bills()
    first = billshift.series_scores(make_txns(rows)).first()["score"]
    again = billshift.series_scores(make_txns(rows[::-1]).repartition(5), chunk_rows=11).first()["score"]
    assert again == pytest.approx(first, abs=1e-9) and 0.3 < first <= 1.0


# --- whole tables ------------------------------------------------------------------------


def mixed(customers=6, seed=11):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        for _ in range(rng.randint(20, 120)):
            day = dt.date(2022, 1, 1) + dt.timedelta(days=rng.randint(0, 700))
            kind = rng.choice(["credit", "debit"])
            merchant = rng.choice(["salary", "investment"] if kind == "credit" else
                                  ["rent", "utility", "dining", "travel", "investment"])
            series = rng.choice([None, "", "a", "b", "c", "d"]) if kind == "debit" else None
            rows.append((f"c{c}", day.isoformat(), rng.randint(100, 99999) / 100, kind, merchant,
                         series))
    return rows


def test_row_order_and_partitioning_do_not_matter(make_txns, spark):
    rows = mixed()
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    groups = store.feature_groups(max_income_cv=9.0)
    first = store.features_wide(make_txns(rows).repartition(1), groups)
    second = store.features_wide(make_txns(shuffled).repartition(7), groups)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_one_customer_with_a_third_of_all_rows(make_txns, features_of):
    """A dominating customer neither changes nor is changed by the others."""
    rows = mixed()
    heavy = worked_example("heavy") * 100
    got = features_of(make_txns(rows + heavy), "heavy")
    alone = features_of(make_txns(heavy), "heavy")
    assert got == alone
