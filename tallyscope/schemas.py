"""Table schemas, the feature catalogue and the fixed values every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
FEATURE_SCHEMA_VERSION = "1.0.0"
MODEL_VERSION = "0.1.0"


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


CUSTOMERS = _table(
    ("customer_id", T.StringType()),
    ("name", T.StringType()),
    ("occupation", T.StringType()),
    ("employer_tenure_months", T.IntegerType()),
    ("city", T.StringType()),
    ("account_vintage_months", T.IntegerType()),
    ("persona_type", T.StringType()),
)

TRANSACTIONS = _table(
    ("transaction_id", T.StringType()),
    ("customer_id", T.StringType()),
    ("date", T.DateType()),
    ("amount", AMOUNT),
    ("category", T.StringType()),
    ("type", T.StringType()),
    ("merchant_category", T.StringType()),
    ("recurring_group_id", T.StringType()),
)

# The stored form: partitioned by calendar month, counted from year 0.
STORED_TRANSACTIONS = T.StructType(
    [*TRANSACTIONS.fields, T.StructField("month_idx", T.IntegerType())]
)

LABELS = _table(
    ("customer_id", T.StringType()),
    ("product", T.StringType()),
    ("converted", T.BooleanType()),
)

FEATURE_RUNS = _table(
    ("group_name", T.StringType()),
    ("state", T.StringType()),
    ("features", T.LongType()),
    ("message", T.StringType()),
    ("computed_at", T.DateType()),
)

INGESTION_LOG = _table(
    ("filename", T.StringType()),
    ("row_count", T.LongType()),
    ("rows_accepted", T.LongType()),
    ("rows_rejected", T.LongType()),
    ("rejection_sample", T.StringType()),
    ("ingested_at", T.TimestampType()),
)

FEATURES = _table(
    ("customer_id", T.StringType()),
    ("feature_name", T.StringType()),
    ("feature_value", T.DoubleType()),
    ("feature_schema_version", T.StringType()),
    ("data_completeness_score", T.DoubleType()),
    ("computed_at", T.DateType()),
)

THRESHOLDS = _table(
    ("product", T.StringType()),
    ("max_dti", T.DoubleType()),
    ("min_vintage_months", T.IntegerType()),
    ("min_confidence", T.DoubleType()),
)

LEADS = _table(
    ("customer_id", T.StringType()),
    ("name", T.StringType()),
    ("intent_score", T.DoubleType()),
    ("estimated_income", T.DoubleType()),
    ("dti", T.DoubleType()),
    ("confidence", T.DoubleType()),
    ("gate_result", T.StringType()),
)

AUDIT_LOG = _table(
    ("customer_id", T.StringType()),
    ("product", T.StringType()),
    ("capacity_model_version", T.StringType()),
    ("intent_model_version", T.StringType()),
    ("gate_result", T.StringType()),
    ("requesting_role", T.StringType()),
    ("input_feature_hash", T.StringType()),
    ("created_at", T.TimestampType()),
)

CONFIG_CHANGE_LOG = _table(
    ("changed_by_role", T.StringType()),
    ("product", T.StringType()),
    ("field_name", T.StringType()),
    ("old_value", T.StringType()),
    ("new_value", T.StringType()),
    ("created_at", T.TimestampType()),
)

# Feature names by group, in the order the groups are computed.
FEATURE_GROUPS: dict[str, list[str]] = {
    "income": [
        "salary_variance_12m",
        "income_growth_pct",
        "num_income_sources",
        "income_source_tenure_months",
        "salary_amount_median",
    ],
    "cashflow": [
        "avg_monthly_income",
        "avg_monthly_outflow",
        "savings_ratio_6m",
        "liquidity_buffer",
        "expense_volatility",
    ],
    "debt": [
        "emi_punctuality_score",
        "current_dti",
        "debt_trend_direction",
        "num_active_emis",
    ],
    "subscription_cleansing": ["subscription_cleansing_flag", "subscription_cleansing_score"],
    "liquidity_pooling": ["liquidity_pooling_flag", "liquidity_pooling_score"],
    "bill_shift": ["bill_shift_flag", "bill_shift_score"],
}
FEATURE_NAMES: list[str] = [name for names in FEATURE_GROUPS.values() for name in names]

# Features whose stored value is expected to lie in [0, 1.5].
RATIO_FEATURES = [
    "savings_ratio_6m",
    "emi_punctuality_score",
    "salary_variance_12m",
    "expense_volatility",
    "data_completeness_score",
    "subscription_cleansing_score",
    "liquidity_pooling_score",
    "bill_shift_score",
]

# The two features that build the capacity target, kept out of its inputs.
CAPACITY_EXCLUDED = ["avg_monthly_outflow", "salary_amount_median"]

# Merchant categories.
DISCRETIONARY = [
    "entertainment",
    "subscriptions",
    "dining",
    "travel",
    "fuel",
    "jewellery",
    "grocery",
]
BILLS = ["utility", "rent"]

# The products that have trained models.
SUPPORTED_PRODUCTS = ["home_loan"]

# Gate thresholds used when a product or a field has none of its own.
DEFAULT_THRESHOLDS = {"max_dti": 0.5, "min_vintage_months": 6, "min_confidence": 0.3}

# The wording shown for each feature in a reason code.
FEATURE_LABELS = {
    "salary_variance_12m": "Income stability",
    "income_growth_pct": "Income growth trend",
    "num_income_sources": "Number of income sources",
    "income_source_tenure_months": "Income source tenure",
    "salary_amount_median": "Median salary amount",
    "avg_monthly_income": "Average monthly income",
    "avg_monthly_outflow": "Average monthly spending",
    "savings_ratio_6m": "Savings ratio",
    "liquidity_buffer": "Liquidity buffer",
    "expense_volatility": "Spending consistency",
    "emi_punctuality_score": "EMI payment punctuality",
    "current_dti": "Debt-to-income ratio",
    "debt_trend_direction": "Debt trend",
    "num_active_emis": "Active EMI count",
    "subscription_cleansing_score": "Subscription cleanup activity",
    "subscription_cleansing_flag": "Subscription cleanup detected",
    "liquidity_pooling_score": "Liquidity pooling activity",
    "liquidity_pooling_flag": "Liquidity pooling detected",
    "bill_shift_score": "Bill payment shifting",
    "bill_shift_flag": "Bill shifting detected",
    "data_completeness_score": "Data completeness",
}
