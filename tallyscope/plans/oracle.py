"""The same results as ``queries``, written separately as plain SQL over the supplied tables.

The SQL takes other routes on purpose: month series are really generated, slopes come from
``regr_slope`` over the generated months, medians and deviations from whole groups, and the
reinvestment check is a correlated ``NOT EXISTS``.
"""

from __future__ import annotations

import re

from tallyscope.schemas import FEATURE_LABELS, RATIO_FEATURES

TXNS = """
txns AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS category,
         'credit' AS type,
         CASE o_orderstatus WHEN 'F' THEN 'salary' WHEN 'O' THEN 'investment'
                            WHEN 'P' THEN 'business_income' END AS merchant_category,
         CAST(NULL AS VARCHAR) AS recurring_group_id
  FROM orders
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CAST(l_shipdate AS DATE),
         CAST(l_extendedprice AS DECIMAL(18,2)), p_type, 'debit',
         CASE p_type WHEN 'PROMO' THEN 'entertainment' WHEN 'ECONOMY' THEN 'grocery'
                     WHEN 'STANDARD' THEN 'utility' WHEN 'LARGE' THEN 'rent'
                     WHEN 'MEDIUM' THEN 'subscriptions' WHEN 'SMALL' THEN 'investment' END,
         CASE WHEN l_linenumber <= 6
              THEN p_type || '-' || CAST(l_suppkey % 2 AS VARCHAR) END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""


def middle(x: str, where: str = "") -> str:
    """Interpolated median of exact decimals, rounded to cents without a detour over doubles."""
    part = f"list({x}) FILTER (WHERE {where})" if where else f"list({x})"
    n = f"len({part})"
    ordered = f"list_sort({part})"
    return (
        f"(CAST({ordered}[({n} + 1) // 2] + {ordered}[{n} // 2 + 1] AS DECIMAL(18,2)) * 0.5)"
    )


def cents_middle(x: str, where: str = "") -> str:
    return f"CAST(round({middle(x, where)}, 2) AS DOUBLE)"


def dense(src: str = "txns", p: str = "") -> str:
    """CTEs with every month between a customer's first and last transaction."""
    return f"""
{p}sums AS (
  SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month,
         sum(amount) FILTER (WHERE type = 'credit') AS credits,
         sum(amount) FILTER (WHERE type = 'debit') AS debits
  FROM {src} GROUP BY ALL
), {p}spine AS (
  SELECT customer_id,
         CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM {p}sums GROUP BY customer_id
), {p}dense AS (
  SELECT customer_id, month, CAST(coalesce(credits, 0) AS DECIMAL(18,2)) AS credits,
         CAST(coalesce(debits, 0) AS DECIMAL(18,2)) AS debits,
         row_number() OVER (PARTITION BY customer_id ORDER BY month) - 1 AS pos,
         row_number() OVER (PARTITION BY customer_id ORDER BY month DESC) AS back,
         count(*) OVER (PARTITION BY customer_id) AS span
  FROM {p}spine LEFT JOIN {p}sums USING (customer_id, month)
)"""


def cash(src: str = "txns", p: str = "") -> str:
    return f"""{dense(src, p)}, {p}cash AS (
  SELECT customer_id,
         {cents_middle('credits')} AS avg_monthly_income,
         {cents_middle('debits')} AS avg_monthly_outflow,
         round(median(CASE WHEN credits > 0 THEN CAST(credits - debits AS DOUBLE)
                           / CAST(credits AS DOUBLE) ELSE 0.0 END), 4) + 0.0
           AS savings_ratio_6m,
         CAST(min(credits - debits) FILTER (WHERE back <= 3) AS DOUBLE) AS liquidity_buffer,
         CASE WHEN avg(CAST(debits AS DOUBLE)) > 0 AND count(*) > 1
              THEN round(stddev_samp(CAST(debits AS DOUBLE)) / avg(CAST(debits AS DOUBLE)), 4)
              ELSE 0.0 END AS expense_volatility,
         round(least(1.0, max(span) / 12.0), 4) AS completeness
  FROM {p}dense WHERE back <= 6 GROUP BY customer_id
)"""


def pay(src: str = "txns", p: str = "") -> str:
    """Income features; needs the dense months of ``cash``."""
    return f"""
{p}salary_months AS (
  SELECT customer_id, date_trunc('month', date) AS month, sum(amount) AS salary
  FROM {src} WHERE type = 'credit' AND merchant_category = 'salary' GROUP BY ALL
), {p}salary AS (
  SELECT customer_id, count(*) AS salary_months,
         CASE WHEN count(*) = 1 OR avg(CAST(salary AS DOUBLE)) <= 0 THEN 0.0
              ELSE round(stddev_samp(CAST(salary AS DOUBLE)) / avg(CAST(salary AS DOUBLE)), 4)
         END AS salary_variance_12m,
         {cents_middle('salary')} AS salary_amount_median
  FROM {p}salary_months GROUP BY customer_id
), {p}growth AS (
  SELECT customer_id, max(span) AS months,
         CASE WHEN max(span) < 3 OR sum(credits) IS NULL THEN NULL
              WHEN avg(CAST(credits AS DOUBLE)) > 0
              THEN round(regr_slope(CAST(credits AS DOUBLE), pos)
                         / avg(CAST(credits AS DOUBLE)) * 100, 4) + 0.0
              ELSE 0.0 END AS growth
  FROM {p}dense GROUP BY customer_id
), {p}person AS (
  SELECT customer_id, max(date) AS last_date,
         min(date) FILTER (WHERE type = 'credit' AND merchant_category = 'salary') AS first_salary,
         count(DISTINCT category) FILTER (WHERE type = 'credit') AS sources,
         count(*) FILTER (WHERE type = 'credit') AS n_credits,
         count(DISTINCT date_trunc('month', date)) AS active
  FROM {src} GROUP BY customer_id
), {p}pay AS (
  SELECT customer_id, salary_variance_12m,
         CASE WHEN n_credits > 0 THEN growth END AS income_growth_pct,
         CAST(sources AS DOUBLE) AS num_income_sources,
         coalesce(round((last_date - first_salary) / 30.0, 1), 0.0) AS income_source_tenure_months,
         coalesce(salary_amount_median, 0.0) AS salary_amount_median,
         round(least(1.0, active / 12.0), 4) AS completeness
  FROM {p}person JOIN {p}growth USING (customer_id) LEFT JOIN {p}salary USING (customer_id)
)"""


EMI = """
series AS (
  SELECT customer_id, recurring_group_id, count(*) AS payments,
         count(*) FILTER (WHERE day(date) <= 5) AS on_time,
         CASE WHEN avg(CAST(amount AS DOUBLE)) > 0
              THEN stddev_samp(CAST(amount AS DOUBLE)) / avg(CAST(amount AS DOUBLE))
              ELSE 1.0 END AS cv
  FROM txns WHERE type = 'debit' AND coalesce(recurring_group_id, '') <> '' GROUP BY ALL
), emi AS (SELECT * FROM series WHERE payments >= 3 AND cv < 0.10)"""

DEBT = f"""{EMI}, emi_months AS (
  SELECT t.customer_id, CAST(date_trunc('month', t.date) AS DATE) AS month, sum(amount) AS paid
  FROM txns t JOIN emi USING (customer_id, recurring_group_id)
  WHERE t.type = 'debit' GROUP BY ALL
), active AS (
  SELECT customer_id, count(DISTINCT date_trunc('month', date)) AS active FROM txns GROUP BY 1
), dti AS (
  SELECT customer_id, CAST({middle('credits')} AS DOUBLE) AS income,
         CAST({middle('due')} AS DOUBLE) AS due
  FROM (SELECT d.customer_id, d.credits, CAST(coalesce(e.paid, 0) AS DECIMAL(18,2)) AS due
        FROM dense d JOIN active USING (customer_id)
        LEFT JOIN emi_months e ON d.customer_id = e.customer_id AND d.month = e.month
        WHERE back <= least(3, active))
  GROUP BY customer_id
), emi_counts AS (
  SELECT customer_id, count(*) AS n, round(sum(on_time) / sum(payments), 4) AS punctual
  FROM emi GROUP BY customer_id
), debit_span AS (
  SELECT customer_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))
                           AS DATE) AS month
  FROM sums WHERE debits IS NOT NULL GROUP BY customer_id
), debit_trend AS (
  SELECT customer_id, count(*) AS span,
         regr_slope(CAST(coalesce(debits, 0) AS DOUBLE), pos) AS slope,
         avg(CAST(coalesce(debits, 0) AS DOUBLE)) AS mean
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month) - 1 AS pos
        FROM debit_span LEFT JOIN sums USING (customer_id, month))
  GROUP BY customer_id
), debt AS (
  SELECT customer_id, punctual AS emi_punctuality_score,
         CASE WHEN income > 0 THEN round(due / income, 4) ELSE 0.0 END AS current_dti,
         CASE WHEN t.span IS NULL OR active < 3 THEN NULL
              WHEN t.span >= 3 AND mean > 0 THEN round(slope / mean, 4) + 0.0
              ELSE 0.0 END AS debt_trend_direction,
         CAST(coalesce(n, 0) AS DOUBLE) AS num_active_emis,
         round(least(1.0, active / 12.0), 4) AS completeness
  FROM active JOIN dti USING (customer_id) LEFT JOIN emi_counts USING (customer_id)
  LEFT JOIN debit_trend t USING (customer_id)
)"""

SUBS = """
sub_series AS (
  SELECT customer_id, recurring_group_id, max(date) AS ended
  FROM txns
  WHERE type = 'debit' AND coalesce(recurring_group_id, '') <> ''
    AND merchant_category IN ('entertainment', 'subscriptions', 'dining', 'travel', 'fuel',
                              'jewellery', 'grocery')
  GROUP BY ALL HAVING count(*) >= 3
), sub_last AS (SELECT customer_id, max(date) AS last_date FROM txns GROUP BY 1),
credit_months AS (
  SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS credits
  FROM txns WHERE type = 'credit' GROUP BY ALL
), credit_spine AS (
  SELECT customer_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))
                           AS DATE) AS month
  FROM credit_months GROUP BY customer_id
), steady AS (
  SELECT customer_id
  FROM (SELECT customer_id, CAST(coalesce(credits, 0) AS DOUBLE) AS c
        FROM credit_spine LEFT JOIN credit_months USING (customer_id, month))
  GROUP BY customer_id
  HAVING count(*) >= 3
     AND CASE WHEN avg(c) > 0 THEN stddev_samp(c) / avg(c) ELSE 1.0 END < 2.5
), stopped AS (
  SELECT customer_id, ended,
         lead(ended, 2) OVER (PARTITION BY customer_id ORDER BY ended) AS third
  FROM sub_series JOIN sub_last USING (customer_id) WHERE last_date - ended >= 30
), sub_flags AS (
  SELECT s.customer_id, round(s.n_stopped / t.n, 4) AS score
  FROM (SELECT customer_id, count(*) AS n_stopped, min(third - ended) AS gap
        FROM stopped GROUP BY 1) s
  JOIN (SELECT customer_id, count(*) AS n FROM sub_series GROUP BY 1) t USING (customer_id)
  JOIN steady USING (customer_id)
  WHERE t.n >= 3 AND s.n_stopped >= 3 AND gap <= 60
), subs AS (
  SELECT customer_id,
         CASE WHEN score IS NULL THEN 0.0 ELSE 1.0 END AS subscription_cleansing_flag,
         coalesce(score, 0.0) AS subscription_cleansing_score
  FROM sub_last LEFT JOIN sub_flags USING (customer_id)
)"""

POOL = """
mids AS (
  SELECT customer_id, median(CAST(amount AS DOUBLE)) AS mid, max(date) AS last_date
  FROM txns GROUP BY customer_id
), open_maturity AS (
  SELECT c.customer_id, c.date AS matured, max(c.amount) AS largest, any_value(last_date) AS last
  FROM txns c JOIN mids USING (customer_id)
  WHERE c.type = 'credit' AND c.merchant_category = 'investment' AND c.amount >= 5 * mid
    AND NOT EXISTS (SELECT 1 FROM txns d
                    WHERE d.customer_id = c.customer_id AND d.type = 'debit'
                      AND d.merchant_category = 'investment'
                      AND d.date > c.date AND d.date <= c.date + 45)
  GROUP BY c.customer_id, c.date
), pool AS (
  SELECT customer_id,
         CASE WHEN gap IS NULL THEN 0.0 ELSE 1.0 END AS liquidity_pooling_flag,
         CASE WHEN gap IS NULL THEN 0.0 ELSE round(gap / 90.0, 4) END
           AS liquidity_pooling_score
  FROM mids LEFT JOIN (SELECT customer_id, max(least(last - matured, 90)) AS gap
                       FROM open_maturity GROUP BY 1) USING (customer_id)
)"""

BILLS = """
bills AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id, recurring_group_id
                               ORDER BY date, amount) AS rn,
         count(*) OVER (PARTITION BY customer_id, recurring_group_id) AS n
  FROM txns WHERE type = 'debit' AND merchant_category IN ('utility', 'rent')
              AND coalesce(recurring_group_id, '') <> ''
), drifts AS (
  SELECT customer_id, recurring_group_id, any_value(n) AS n,
         CASE WHEN any_value(n) >= 5
              THEN avg(day(date)) FILTER (WHERE rn > n // 2)
                   - avg(day(date)) FILTER (WHERE rn <= n // 2) END AS drift
  FROM bills GROUP BY ALL
)"""

RAW = """
cells AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         o_orderpriority AS category, 'credit' AS type,
         CASE o_orderstatus WHEN 'F' THEN 'salary' WHEN 'O' THEN 'investment'
                            WHEN 'P' THEN 'business_income' END AS merchant_category,
         CAST(NULL AS VARCHAR) AS recurring_group_id
  FROM orders
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR),
         CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN 'not-a-date'
              ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END,
         CASE WHEN l_discount = 0.1 AND l_tax = 0.07 THEN 'abc'
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END,
         p_type,
         CASE WHEN l_discount = 0.1 AND l_quantity >= 49 THEN 'transfer' ELSE 'debit' END,
         CASE p_type WHEN 'PROMO' THEN 'entertainment' WHEN 'ECONOMY' THEN 'grocery'
                     WHEN 'STANDARD' THEN 'utility' WHEN 'LARGE' THEN 'rent'
                     WHEN 'MEDIUM' THEN 'subscriptions' WHEN 'SMALL' THEN 'investment' END,
         CASE WHEN l_linenumber <= 6
              THEN p_type || '-' || CAST(l_suppkey % 2 AS VARCHAR) END
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), checked AS (
  SELECT *,
         CASE WHEN date = 'not-a-date' THEN 1 ELSE 0 END
         + CASE WHEN amount = 'abc' THEN 1 ELSE 0 END
         + CASE WHEN type = 'transfer' THEN 1 ELSE 0 END AS error_count,
         substr(sha256(customer_id || '|' || date || '|' || amount || '|' || category || '|'
                       || type || '|' || merchant_category), 1, 16) AS transaction_id
  FROM cells
), reasons AS (
  SELECT *, 'Row cid=' || customer_id || ' date=' || date || ': '
            || CAST(error_count AS VARCHAR) || ' validation errors' AS reason,
         row_number() OVER (PARTITION BY type ORDER BY customer_id, date, amount, category,
                            coalesce(recurring_group_id, '')) AS rn
  FROM checked WHERE error_count > 0
)"""

INCOME_NAMES = ["salary_variance_12m", "income_growth_pct", "num_income_sources",
                "income_source_tenure_months", "salary_amount_median"]
CASH_NAMES = ["avg_monthly_income", "avg_monthly_outflow", "savings_ratio_6m",
              "liquidity_buffer", "expense_volatility"]
DEBT_NAMES = ["emi_punctuality_score", "current_dti", "debt_trend_direction", "num_active_emis"]
SUB_NAMES = ["subscription_cleansing_flag", "subscription_cleansing_score"]
POOL_NAMES = ["liquidity_pooling_flag", "liquidity_pooling_score"]
ALL_NAMES = INCOME_NAMES + CASH_NAMES + DEBT_NAMES + SUB_NAMES + POOL_NAMES


def unpivoted(table: str, names: list[str], day: str, complete: str = "completeness") -> str:
    parts = [
        f"SELECT customer_id, '{n}' AS feature_name, {n} AS feature_value, "
        f"'1.0.0' AS feature_schema_version, CAST({complete} AS DOUBLE) AS "
        f"data_completeness_score, '{day}' AS computed_at FROM {table} WHERE {n} IS NOT NULL"
        for n in names
    ]
    return " UNION ALL ".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "


def early(sql: str) -> str:
    """The same common table expressions over the early transactions, as ``e_`` tables."""
    tables = re.findall(r"(\w+) AS \(\s*SELECT", ", ".join([cash(), pay(), DEBT, SUBS, POOL]))
    for name in sorted(set(tables), key=len, reverse=True):
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2e_{name}", sql)
        sql = re.sub(rf"\b{name}( AS \(|\.)", rf"e_{name}\1", sql)
    return re.sub(r"\b(FROM|JOIN)(\s+)txns\b", r"\1\2early", sql)


EARLY_TXNS = "early AS (SELECT * FROM txns WHERE date < DATE '1999-01-01')"
HISTORY = ", ".join([
    TXNS, EARLY_TXNS, cash(), pay(), DEBT, SUBS, POOL,
    cash("early", "e_"), pay("early", "e_"), early(DEBT), early(SUBS), early(POOL),
    "history AS (" + " UNION ALL ".join([
        unpivoted("e_pay", INCOME_NAMES, "1999-01-01"),
        unpivoted("e_cash", CASH_NAMES, "1999-01-01"),
        unpivoted("e_debt", DEBT_NAMES, "1999-01-01"),
        unpivoted("e_subs", SUB_NAMES, "1999-01-01", "1.0"),
        unpivoted("e_pool", POOL_NAMES, "1999-01-01", "1.0"),
        unpivoted("pay", INCOME_NAMES, "2002-01-01"),
        unpivoted("cash", CASH_NAMES, "2002-01-01"),
        unpivoted("debt", DEBT_NAMES, "2002-01-01"),
        unpivoted("subs", SUB_NAMES, "2002-01-01", "1.0"),
        unpivoted("pool", POOL_NAMES, "2002-01-01", "1.0"),
    ]) + ")",
    "vectors AS (SELECT customer_id, " + ", ".join(
        f"arg_max(feature_value, computed_at) FILTER (WHERE feature_name = '{n}') AS {n}"
        for n in ALL_NAMES
    ) + " FROM history GROUP BY customer_id)",
])
SCORED = """scored AS (
  SELECT customer_id, c_name AS name, 'home_loan' AS product,
         avg_monthly_income - avg_monthly_outflow AS q50,
         round(greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + coalesce(income_growth_pct, 0.0)
               / CAST(5 AS DOUBLE))) * 100, 2) AS intent_score,
         round(greatest(0.0, least(1.0, 1 - expense_volatility / CAST(2.5 AS DOUBLE))), 4)
           AS cap_conf,
         round(abs(greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + coalesce(income_growth_pct, 0.0)
               / CAST(5 AS DOUBLE))) - 0.5) * 2, 4) AS int_conf,
         coalesce(current_dti, 0.0) AS dti,
         CAST(trunc(coalesce(income_source_tenure_months, 0)) AS INTEGER)
           AS account_vintage_months
  FROM cash JOIN pay USING (customer_id) JOIN debt USING (customer_id)
  JOIN customer ON customer_id = CAST(c_custkey AS VARCHAR)
), gated AS (
  SELECT *, least(cap_conf, int_conf) AS confidence,
         CASE WHEN dti > 0.5 THEN 'fail'
              WHEN account_vintage_months < 6 OR least(cap_conf, int_conf) < 0.3
              THEN 'manual_review' ELSE 'pass' END AS gate_result
  FROM scored
)"""
GATED = ", ".join([TXNS, cash(), pay(), DEBT, SCORED])
HASHES = """
hashes AS (
  SELECT customer_id, sha256(string_agg(feature_name || '='
           || CAST(CAST(feature_value AS DECIMAL(38,6)) AS VARCHAR), ';' ORDER BY feature_name))
           AS input_feature_hash
  FROM (SELECT customer_id, feature_name, arg_max(feature_value, computed_at) AS feature_value
        FROM history GROUP BY ALL) GROUP BY customer_id
)"""
LEADS = """SELECT customer_id, name, round(intent_score, 2) AS intent_score,
  round(q50, 2) AS estimated_income, round(dti, 4) AS dti, round(confidence, 4) AS confidence,
  gate_result FROM gated WHERE gate_result = 'pass' AND intent_score >= 20.0"""
THRESHOLDS = """
updates AS (
  SELECT s_name AS product, round(s_acctbal / 8000, 2) + 0.0 AS max_dti,
         CASE WHEN s_nationkey > 4 THEN s_nationkey - 5 END AS min_vintage_months,
         CASE WHEN s_acctbal > 5000 THEN CAST(0.3 AS DOUBLE) END AS min_confidence
  FROM supplier
), judged AS (
  SELECT *,
    concat_ws('; ',
      CASE WHEN max_dti < 0 OR max_dti > 1
           THEN 'max_dti must be between 0 and 1, got ' || CAST(max_dti AS VARCHAR) END,
      CASE WHEN min_vintage_months < 1
           THEN 'min_vintage_months must be a positive integer, got '
                || CAST(min_vintage_months AS VARCHAR) END,
      CASE WHEN min_confidence < 0 OR min_confidence > 1
           THEN 'min_confidence must be between 0 and 1, got '
                || CAST(min_confidence AS VARCHAR) END) AS errors
  FROM updates
), valid AS (SELECT * FROM judged WHERE errors = '')"""
DOCS = """
docs AS (
  SELECT doc_id, quality, CAST(n_chars AS DOUBLE) AS n_chars, quality * 500.0 + 1000.0 AS guess,
         quality * 200.0 + 100.0 AS low, quality * 1000.0 + 2000.0 AS high
  FROM labels JOIN documents USING (doc_id)
)"""

UPSERTED = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, coalesce(o.name, c_name) AS name
FROM customer LEFT JOIN (
  SELECT o_custkey, 'order ' || CAST(o_orderkey AS VARCHAR) AS name,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
  FROM orders) o ON c_custkey = o_custkey AND rn = 1"""

ORACLE: dict[str, str] = {
    "txn_canonical": with_(TXNS) + """
SELECT customer_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, category,
       type, merchant_category, recurring_group_id FROM txns""",
    "ingest_accept": with_(RAW) + """
SELECT transaction_id, customer_id, date, CAST(amount AS DOUBLE) AS amount, category, type,
       merchant_category, recurring_group_id FROM checked WHERE error_count = 0""",
    "csv_accept": with_(RAW) + """
SELECT transaction_id, customer_id, date, CAST(amount AS DOUBLE) AS amount, category, type,
       merchant_category, recurring_group_id FROM checked WHERE error_count = 0""",
    "stream_ingest": with_(RAW) + """
SELECT transaction_id, 1 AS copies, max(customer_id) AS customer_id, 0 AS replayed
FROM checked WHERE error_count = 0 GROUP BY transaction_id""",
    "ingest_reject": with_(RAW) + """
SELECT customer_id, type, CAST(error_count AS INTEGER) AS error_count, reason FROM reasons""",
    "ingest_log": with_(RAW) + """
SELECT c.type || '.csv' AS filename, count(*) AS row_count,
       count(*) FILTER (WHERE error_count = 0) AS rows_accepted,
       count(*) FILTER (WHERE error_count > 0) AS rows_rejected,
       substr(coalesce(any_value(sample), ''), 1, 500) AS rejection_sample
FROM checked c
LEFT JOIN (SELECT type, string_agg(reason, '; ' ORDER BY rn) AS sample
           FROM reasons WHERE rn <= 5 GROUP BY type) r ON c.type = r.type
GROUP BY c.type""",
    "txn_hash_id": with_(RAW) + """
SELECT transaction_id, count(*) AS copies FROM checked WHERE error_count = 0
GROUP BY transaction_id""",
    "dedupe_first_wins": with_(RAW) + """
SELECT transaction_id, customer_id, min(recurring_group_id_) AS recurring_group_id FROM (
  SELECT transaction_id, customer_id, first_value(recurring_group_id) OVER (
           PARTITION BY transaction_id ORDER BY coalesce(recurring_group_id, ''))
           AS recurring_group_id_
  FROM checked WHERE error_count = 0
    AND transaction_id NOT IN (SELECT transaction_id FROM checked
                               WHERE error_count = 0 AND date < '1996-01-01'))
GROUP BY transaction_id, customer_id""",
    "upsert_last_wins": UPSERTED,
    "upsert_buckets": UPSERTED,
    "customer_checks": """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name, c_mktsegment AS occupation,
       CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS INTEGER) END AS employer_tenure_months,
       CAST(NULL AS VARCHAR) AS city,
       CASE WHEN c_acctbal <= 9000 THEN CAST(c_nationkey AS INTEGER) END
         AS account_vintage_months,
       CAST(NULL AS VARCHAR) AS persona_type, 'customers.csv' AS source_file,
       CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS error_count,
       CASE WHEN c_acctbal > 9000 THEN 'Row customer_id=' || CAST(c_custkey AS VARCHAR)
                                       || ': 1 validation errors' END AS reason
FROM customer""",
    "label_normalise": """
SELECT CAST(doc_id AS VARCHAR) AS customer_id, 'home_loan' AS product,
       quality = 1 AS converted FROM labels""",
    "monthly_cashflow": with_(TXNS, dense()) + """
SELECT customer_id, CAST(month AS VARCHAR) AS month, CAST(credits AS DOUBLE) AS credits,
       CAST(debits AS DOUBLE) AS debits FROM dense""",
    "cashflow_features": with_(TXNS, cash()) + "SELECT * FROM cash",
    "income_features": with_(TXNS, cash(), pay()) + "SELECT * FROM pay",
    "salary_stats": with_(TXNS, cash(), pay()) + "SELECT * FROM salary",
    "income_growth": with_(TXNS, cash(), pay()) + """
SELECT customer_id, CAST(months AS INTEGER) AS months, income_growth_pct
FROM growth JOIN pay USING (customer_id)""",
    "minimal_features": with_(TXNS, dense()) + """
SELECT customer_id, CAST(200 * inc + n AS BIGINT) // (2 * n) / 100.0 AS avg_monthly_income,
       CAST(200 * outg + n AS BIGINT) // (2 * n) / 100.0 AS avg_monthly_outflow,
       CASE WHEN inc <> 0 THEN round(CAST(inc - outg AS DOUBLE) / CAST(inc AS DOUBLE), 4) END
         AS savings_ratio
FROM (SELECT customer_id, count(*) AS n, coalesce(sum(credits), 0) AS inc,
             coalesce(sum(debits), 0) AS outg FROM sums GROUP BY 1)""",
    "emi_series": with_(TXNS, EMI) + """
SELECT customer_id, recurring_group_id, payments, on_time, round(cv, 4) AS amount_cv FROM emi""",
    "debt_features": with_(TXNS, dense(), DEBT) + "SELECT * FROM debt",
    "emi_punctuality": with_(TXNS, dense(), DEBT)
    + "SELECT customer_id, emi_punctuality_score FROM debt",
    "current_dti": with_(TXNS, dense(), DEBT) + "SELECT customer_id, current_dti FROM debt",
    "debt_trend": with_(TXNS, dense(), DEBT)
    + "SELECT customer_id, debt_trend_direction FROM debt",
    "subscription_cleansing": with_(TXNS, SUBS) + "SELECT * FROM subs",
    "open_maturities": with_(TXNS, POOL) + """
SELECT customer_id, CAST(matured AS VARCHAR) AS matured, CAST(largest AS DOUBLE) AS largest
FROM open_maturity""",
    "liquidity_pooling": with_(TXNS, POOL) + "SELECT * FROM pool",
    "bill_shift_drift": with_(TXNS, BILLS) + """
SELECT customer_id, sum(n) AS bills, count(*) FILTER (WHERE drift > 3) AS drifting_series,
       max(round(drift, 4)) FILTER (WHERE drift > 3) AS largest_drift
FROM drifts GROUP BY customer_id HAVING sum(n) >= 6""",
    "customers_with_txns": with_(TXNS) + "SELECT DISTINCT customer_id FROM txns",
    "features_long": with_(TXNS, cash(), pay(), DEBT, SUBS, POOL) + " UNION ALL ".join([
        unpivoted("pay", INCOME_NAMES, "2002-01-01"),
        unpivoted("cash", CASH_NAMES, "2002-01-01"),
        unpivoted("debt", DEBT_NAMES, "2002-01-01"),
        unpivoted("subs", SUB_NAMES, "2002-01-01", "1.0"),
        unpivoted("pool", POOL_NAMES, "2002-01-01", "1.0"),
    ]),
    "nightly_outcomes": with_(TXNS, cash(), pay(), DEBT, SUBS, POOL) + " UNION ALL ".join([
        f"SELECT '{group}' AS group_name, 'stored' AS state, count(*) AS features FROM ("
        + unpivoted(view, names, "2002-01-01", *complete) + ")"
        for group, view, names, *complete in [
            ("income", "pay", INCOME_NAMES), ("cashflow", "cash", CASH_NAMES),
            ("debt", "debt", DEBT_NAMES), ("subscription_cleansing", "subs", SUB_NAMES, "1.0"),
            ("liquidity_pooling", "pool", POOL_NAMES, "1.0")]
    ]),
    "forest_quantiles_of_leaves": """
WITH trees AS (SELECT unnest(range(7)) AS tree),
fitted AS (
  SELECT tree, (l_suppkey + tree * l_linenumber) % 4 AS leaf, CAST(l_quantity AS DOUBLE) AS target
  FROM lineitem, trees WHERE l_linenumber <= 7
), shares AS (
  SELECT tree, leaf, target, count(*) / sum(count(*)) OVER (PARTITION BY tree, leaf) / 7 AS w
  FROM fitted GROUP BY tree, leaf, target
), pooled AS (
  SELECT f AS first, target, sum(sum(w)) OVER (PARTITION BY f ORDER BY target) AS reached
  FROM (SELECT unnest(range(4)) AS f), shares WHERE leaf = (f + tree) % 4
  GROUP BY f, target
), found AS (
  SELECT first, min(target) FILTER (reached >= 0.1 - 1e-9) AS q10,
         min(target) FILTER (reached >= 0.5 - 1e-9) AS q50,
         min(target) FILTER (reached >= 0.9 - 1e-9) AS q90
  FROM pooled GROUP BY first
)
SELECT CAST(o_orderkey AS VARCHAR) AS customer_id, q10, q50, q90
FROM orders JOIN found ON o_custkey % 4 = first""",
    "features_asof": "WITH " + HISTORY + """
SELECT customer_id, feature_name, arg_max(feature_value, computed_at) AS feature_value,
       max(computed_at) AS computed_at
FROM history WHERE computed_at <= '2000-01-01' GROUP BY ALL""",
    "features_asof_state": "WITH " + HISTORY + """
SELECT customer_id, feature_name, arg_max(feature_value, computed_at) AS feature_value,
       max(computed_at) AS computed_at
FROM history GROUP BY ALL""",
    "feature_vectors": "WITH " + HISTORY + " SELECT * FROM vectors",
    "feature_warnings": "WITH " + HISTORY + """
SELECT customer_id, feature_name, feature_value FROM history
WHERE computed_at = '2002-01-01' AND NOT feature_value BETWEEN 0.0 AND 1.5
  AND feature_name IN (""" + ", ".join(f"'{n}'" for n in RATIO_FEATURES) + ")",
    "features_rerun": "WITH " + HISTORY
    + " SELECT feature_name, computed_at, count(*) AS n FROM history GROUP BY ALL",
    "eligibility_gate": "WITH " + GATED + """
SELECT customer_id, dti, account_vintage_months, confidence, gate_result,
       'dti_below_0.5; vintage_above_6m; confidence_above_0.3' AS rules_checked,
       concat_ws('; ',
         CASE WHEN dti > 0.5 THEN 'DTI ' || CAST(CAST(dti AS DECIMAL(18,4)) AS VARCHAR)
                                  || ' exceeds 0.50' END,
         CASE WHEN account_vintage_months < 6
              THEN 'Account vintage ' || CAST(account_vintage_months AS VARCHAR)
                   || 'm below 6m minimum' END,
         CASE WHEN confidence < 0.3
              THEN 'Model confidence ' || CAST(CAST(confidence AS DECIMAL(18,4)) AS VARCHAR)
                   || ' below 0.30 minimum' END) AS rules_failed
FROM gated""",
    "gate_by_product": "WITH " + GATED + """, limits AS (
  SELECT 'loan_' || CAST(r_regionkey AS VARCHAR) AS product,
         r_regionkey * CAST(0.2 AS DOUBLE) AS max_dti,
         CASE WHEN r_regionkey <> 2 THEN r_regionkey * 10 + 1 END AS min_vintage_months,
         r_regionkey * CAST(0.25 AS DOUBLE) AS min_confidence
  FROM region WHERE r_regionkey < 4
), cases AS (
  SELECT customer_id, 'loan_' || CAST(k % 5 AS VARCHAR) AS product,
         CASE WHEN k % 7 <> 0 THEN dti END AS dti,
         CASE WHEN k % 11 <> 0 THEN confidence END AS confidence,
         CASE WHEN k % 13 <> 0 THEN account_vintage_months END AS vintage
  FROM (SELECT *, CAST(customer_id AS BIGINT) AS k FROM gated)
), ruled AS (
  SELECT customer_id, product, dti, vintage, confidence, coalesce(max_dti, 0.5) AS a,
         coalesce(min_vintage_months, 6) AS b, coalesce(min_confidence, 0.3) AS c
  FROM cases LEFT JOIN limits USING (product)
), failed AS (
  SELECT *, NOT coalesce(dti <= a, false) AS x, NOT coalesce(vintage >= b, false) AS y,
         NOT coalesce(confidence >= c, false) AS z FROM ruled
)
SELECT customer_id, product,
       CASE WHEN x THEN 'fail' WHEN y OR z THEN 'manual_review' ELSE 'pass' END AS gate_result,
       'dti_below_' || CAST(a AS VARCHAR) || '; vintage_above_' || CAST(b AS VARCHAR)
         || 'm; confidence_above_' || CAST(c AS VARCHAR) AS rules_checked,
       CAST(x AS INTEGER) + CAST(y AS INTEGER) + CAST(z AS INTEGER) AS failures,
       concat_ws('; ', CASE WHEN dti IS NULL THEN 'DTI is unknown' END,
                 CASE WHEN vintage IS NULL THEN 'Account vintage is unknown' END,
                 CASE WHEN confidence IS NULL THEN 'Model confidence is unknown' END) AS unknown
FROM failed""",
    "confidence_of_intervals": """
SELECT CAST(o_orderkey AS VARCHAR) AS customer_id,
       CASE WHEN q50 <> 0 THEN round(greatest(0.0, least(1.0, 1 - abs((q90 - q10) / q50))), 4)
            ELSE 0.0 END AS capacity_confidence
FROM (SELECT o_orderkey, q50, q50 - w * 700 AS q10, q50 + w * 900 AS q90
      FROM (SELECT o_orderkey, o_totalprice - CAST(100000 AS DOUBLE) AS q50,
                   CAST(o_custkey % 100 AS DOUBLE) AS w FROM orders))""",
    "scores_of_probabilities": """
SELECT CAST(o_orderkey AS VARCHAR) AS customer_id, round(p * 100, 2) AS intent_score,
       round(abs(p - 0.5) * 2, 4) AS intent_confidence
FROM (SELECT o_orderkey, (o_orderkey % 1000) / CAST(999 AS DOUBLE) AS p FROM orders)""",
    "reasons_of_contributions": """
WITH parts AS (
  SELECT r, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS customer_id, unnest([
    {'i': 0, 'n': 'current_dti', 'v': l_discount - CAST(0.05 AS DOUBLE)},
    {'i': 1, 'n': 'avg_monthly_income', 'v': l_tax - CAST(0.04 AS DOUBLE)},
    {'i': 2, 'n': 'liquidity_buffer', 'v': l_quantity / CAST(100 AS DOUBLE)},
    {'i': 3, 'n': 'num_active_emis', 'v': CAST(0 AS DOUBLE)},
    {'i': 4, 'n': 'savings_ratio_6m', 'v': -round(l_extendedprice) / CAST(100000 AS DOUBLE)},
    {'i': 5, 'n': 'expense_volatility', 'v': (l_partkey % 3) - CAST(1 AS DOUBLE)},
    {'i': 6, 'n': 'some_other_feature', 'v': (l_suppkey % 7) / CAST(10 AS DOUBLE)}]) AS f
  FROM (SELECT *, row_number() OVER () AS r FROM lineitem)
)
SELECT customer_id, f.n AS feature_name, CASE WHEN f.v > 0 THEN '↑' ELSE '↓' END AS direction,
       CASE f.n """ + " ".join(
        f"WHEN '{n}' THEN '{FEATURE_LABELS[n]}'" for n in [
            "current_dti", "avg_monthly_income", "liquidity_buffer", "num_active_emis",
            "savings_ratio_6m", "expense_volatility"]
    ) + """ ELSE 'Some Other Feature' END AS human_label, round(f.v, 6) AS shap_value
FROM parts WHERE abs(f.v) >= 1e-8
QUALIFY row_number() OVER (PARTITION BY r ORDER BY abs(f.v) DESC, f.i) <= 5""",
    "trivial_score": with_(TXNS, cash()) + """
SELECT customer_id, 'home_loan' AS product,
       round(avg_monthly_income - avg_monthly_outflow, 2) AS estimated_income,
       CAST(0.5 AS DOUBLE) AS confidence, CAST(50.0 AS DOUBLE) AS intent_score FROM cash""",
    "lead_ranking": "WITH " + GATED + "SELECT *, row_number() OVER (ORDER BY intent_score DESC, "
    "customer_id) AS lead_rank FROM (" + LEADS + ") ORDER BY lead_rank",
    "customers_list": """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name FROM customer
ORDER BY customer_id""",
    "feature_hash": "WITH " + HISTORY + ", " + HASHES + "SELECT * FROM hashes",
    "score_audit": "WITH " + ", ".join([HISTORY, SCORED, HASHES]) + """
SELECT customer_id, product, '0.1.0' AS capacity_model_version,
       '0.1.0' AS intent_model_version, gate_result, 'rm' AS requesting_role, input_feature_hash
FROM gated JOIN hashes USING (customer_id)""",
    "audit_trail": """
SELECT CAST(user_id AS VARCHAR) AS customer_id, 'home_loan' AS product,
       '0.1.0' AS capacity_model_version, '0.1.0' AS intent_model_version,
       event_type AS gate_result, 'rm' AS requesting_role, sha256(props) AS input_feature_hash,
       ts AS created_at
FROM events ORDER BY customer_id, created_at DESC""",
    "audit_of_customer": """
SELECT CAST(user_id AS VARCHAR) AS customer_id, 'home_loan' AS product,
       '0.1.0' AS capacity_model_version, '0.1.0' AS intent_model_version,
       event_type AS gate_result, 'rm' AS requesting_role, sha256(props) AS input_feature_hash,
       ts AS created_at
FROM events WHERE user_id = (
  SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id
  ORDER BY count(*) DESC, CAST(user_id AS VARCHAR) LIMIT 1)
ORDER BY customer_id, created_at DESC""",
    "lead_audit_row": "WITH " + GATED + """
SELECT '__leads_batch__' AS customer_id, 'home_loan' AS product,
       'n/a' AS capacity_model_version, 'n/a' AS intent_model_version,
       'returned_' || CAST(count(*) AS VARCHAR) || '_leads' AS gate_result,
       'rm' AS requesting_role, 'min_score=20.0' AS input_feature_hash
FROM (""" + LEADS + ")",
    "threshold_validate": with_(THRESHOLDS) + "SELECT * FROM judged",
    "threshold_changes": with_(THRESHOLDS) + """
SELECT 'admin' AS changed_by_role, product, 'max_dti' AS field_name, '0.5' AS old_value,
       CAST(max_dti AS VARCHAR) AS new_value FROM valid WHERE max_dti <> 0.5
UNION ALL
SELECT 'admin', product, 'min_vintage_months', '6', CAST(min_vintage_months AS VARCHAR)
FROM valid WHERE min_vintage_months <> 6
UNION ALL
SELECT 'admin', product, 'min_confidence', '0.3', CAST(min_confidence AS VARCHAR)
FROM valid WHERE min_confidence <> 0.3""",
    "threshold_apply": with_(THRESHOLDS) + """
SELECT s_name AS product, coalesce(max_dti, 0.5) AS max_dti,
       coalesce(min_vintage_months, 6) AS min_vintage_months,
       coalesce(min_confidence, 0.3) AS min_confidence
FROM supplier LEFT JOIN valid ON s_name = product""",
    "training_matrix": "WITH " + HISTORY + "SELECT v.customer_id, " + ", ".join(
        f"coalesce({n}, 0.0) AS {n}" for n in ALL_NAMES
    ) + """, CAST(quality = 1 AS DOUBLE) AS label
FROM vectors v JOIN labels ON v.customer_id = CAST(doc_id AS VARCHAR)""",
    "capacity_matrix": "WITH " + HISTORY + "SELECT customer_id, " + ", ".join(
        f"coalesce({n}, 0.0) AS {n}" for n in ALL_NAMES
        if n not in ("salary_amount_median", "avg_monthly_outflow")
    ) + """, CASE WHEN salary_amount_median > 0
              THEN salary_amount_median - coalesce(avg_monthly_outflow, 0.0)
              ELSE 0.0 END AS target FROM vectors""",
    "metric_mae": with_(DOCS)
    + "SELECT round(avg(abs(n_chars - guess)), 2) AS mae, count(*) AS n FROM docs",
    "metric_coverage": with_(DOCS) + """
SELECT round(avg(CASE WHEN n_chars BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 4) AS coverage,
       count(*) AS n FROM docs""",
    "metric_auc": with_(DOCS) + """
SELECT round((sum(r) FILTER (WHERE quality = 1)
              - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1)
                / 2.0)
             / (CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE)
                * count(*) FILTER (WHERE quality = 0)), 4) AS auc,
       count(*) FILTER (WHERE quality = 1) AS n_positive, count(*) AS n
FROM (SELECT quality, rank() OVER (ORDER BY n_chars)
             + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM docs)""",
    "metric_precision_topk": with_(DOCS) + """
SELECT round(avg(quality), 4) AS precision_top, count(*) AS k
FROM (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn,
             count(*) OVER () AS n FROM docs)
WHERE rn <= greatest(1, floor(n * CAST(0.2 AS DOUBLE)))""",
}
