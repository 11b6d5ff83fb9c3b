"""The supplied star-schema tables, mapped to customers, transactions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.columns import fixed
from tallyscope.schemas import AMOUNT
from tallyscope.session import shuffles_dropped

# Merchant category by order status and by part type.
CREDIT_MERCHANTS = {"F": "salary", "O": "investment", "P": "business_income"}
DEBIT_MERCHANTS = {
    "PROMO": "entertainment",
    "ECONOMY": "grocery",
    "STANDARD": "utility",
    "LARGE": "rent",
    "MEDIUM": "subscriptions",
    "SMALL": "investment",
}
SERIES_LINES = 6
#: Orders and line items that are joined at a time: their shuffle files lie on disk meanwhile.
SLICE_ROWS = 20_000_000
#: Transactions whose features are computed at a time, for the same reason.
PART_ROWS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(key: str, values: dict[str, str]) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for source, target in values.items():
        chain = chain.when(F.col(key) == source, target)
    return chain


def transaction_rows(spark: SparkSession, sf_dir: str) -> int:
    """Number of orders and line items, from the files' footers."""
    with shuffles_dropped(spark):
        return sum(table(spark, sf_dir, name).count() for name in ("orders", "lineitem"))


def _slice(df: DataFrame, key: str, part: tuple[int, int]) -> DataFrame:
    """The rows of one of some slices by a hash of their key; equal keys of any type meet."""
    number, slices = part
    if slices == 1:
        return df
    place = F.pmod(F.xxhash64(F.col(key).try_cast("double") + F.lit(0.0)), F.lit(slices))
    return df.where(place == number)


def _cash_rows(
    spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)
) -> tuple[DataFrame, DataFrame]:
    """Credits and debits, all of them or those of one slice of the orders (number, slices)."""
    orders = _slice(table(spark, sf_dir, "orders"), "o_orderkey", part)
    credits = orders.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast(AMOUNT).alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.lit("credit").alias("type"),
        _mapped("o_orderstatus", CREDIT_MERCHANTS).alias("merchant_category"),
        F.lit(None).cast("string").alias("recurring_group_id"),
    )
    lines = (
        _slice(table(spark, sf_dir, "lineitem"), "l_orderkey", part)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    group = F.concat_ws("-", "p_type", (F.col("l_suppkey") % 2).cast("string"))
    debits = lines.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").cast(AMOUNT).alias("amount"),
        F.col("p_type").alias("category"),
        F.lit("debit").alias("type"),
        _mapped("p_type", DEBIT_MERCHANTS).alias("merchant_category"),
        F.when(F.col("l_linenumber") <= SERIES_LINES, group).alias("recurring_group_id"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    return credits, debits


def transactions(
    spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)
) -> DataFrame:
    """Orders as credits, line items as debits of the ordering customer."""
    credits, debits = _cash_rows(spark, sf_dir, part)
    return credits.unionByName(debits.drop("l_discount", "l_tax", "l_quantity"))


def raw_transactions(
    spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)
) -> DataFrame:
    """The same rows as text cells, some of them malformed, as a CSV scan would give them."""
    credits, debits = _cash_rows(spark, sf_dir, part)
    deep = F.col("l_discount") == 0.1
    texts = [
        "customer_id",
        F.col("date").cast("string").alias("date"),
        fixed(F.col("amount"), 2).alias("amount"),
        "category",
        "type",
        "merchant_category",
        "recurring_group_id",
    ]
    broken = debits.select(*texts, "l_discount", "l_tax", "l_quantity").select(
        "customer_id",
        F.when(deep & (F.col("l_tax") == 0.08), "not-a-date").otherwise(F.col("date")).alias(
            "date"
        ),
        F.when(deep & (F.col("l_tax") == 0.07), "abc").otherwise(F.col("amount")).alias("amount"),
        "category",
        F.when(deep & (F.col("l_quantity") >= 49), "transfer").otherwise(F.col("type")).alias(
            "type"
        ),
        "merchant_category",
        "recurring_group_id",
    )
    rows = credits.select(*texts).unionByName(broken)
    return rows.select(
        "*",
        F.concat(F.col("type"), F.lit(".csv")).alias("source_file"),
        F.struct(
            "customer_id", "date", "amount", "category",
            F.coalesce("recurring_group_id", F.lit("")).alias("series"),
        ).alias("seq"),
    )


def slices(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The slices of the orders in which their lines are joined one after the other."""
    count = max(1, -(-transaction_rows(spark, sf_dir) // SLICE_ROWS))
    return [(number, count) for number in range(count)]


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of parts of the customers whose features are computed one after the other."""
    return max(1, -(-transaction_rows(spark, sf_dir) // PART_ROWS))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("occupation"),
        F.col("c_nationkey").alias("account_vintage_months"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("customer_id"),
        F.lit("home_loan").alias("product"),
        (F.col("quality") == 1).alias("converted"),
    )
