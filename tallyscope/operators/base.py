"""Base tables of the feature job: all families are rolled up from two tables of cells.

A cell is a group of transactions that every feature treats alike. Operators read cells: raw
transactions become cells of one row each by a projection, which costs no shuffle. The feature job
writes the rows once, so that the raw table is read once, however many families there are. Each
family combines cells before its own shuffle; combining them by their whole key beforehand, as
``combined_activity`` and ``combined_days`` do, pays when many rows share a cell. Sums and squares
are exact decimals, so both ways give the same features.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import in_series, is_debit, month_index
from tallyscope.schemas import BILLS
from tallyscope.session import staged_in_turn

ON_TIME_DAY = 5
INVESTMENT = "investment"
ACTIVITY_KEY = ["customer_id", "month_idx", "type", "merchant_category", "category",
                "recurring_group_id"]
DAY_KEY = ["customer_id", "date", "type", "merchant_category", "recurring_group_id", "amount"]
COLUMNS = [*DAY_KEY, "category"]
#: Rows of a file of the written base, so that tasks that combine them before a shuffle have few.
ROWS_PER_FILE = 100_000
PART = "_part"


def activity_cells(txns: DataFrame) -> DataFrame:
    """Cells by customer, month, type, categories and series: rows, amount (their sum), squares,
    first_date, last_date, on_time. Cells are returned as they are."""
    if "rows" in txns.columns:
        return txns
    return txns.select(
        "customer_id", month_index(F.col("date")).alias("month_idx"), *ACTIVITY_KEY[2:],
        F.lit(1).alias("rows"), "amount", (F.col("amount") * F.col("amount")).alias("squares"),
        F.col("date").alias("first_date"), F.col("date").alias("last_date"),
        F.coalesce(F.dayofmonth("date") <= ON_TIME_DAY, F.lit(False)).cast("int").alias("on_time"),
    )


def combined_activity(txns: DataFrame) -> DataFrame:
    """Activity cells combined by their whole key, which no single customer can make hot."""
    return activity_cells(txns).groupBy(*ACTIVITY_KEY).agg(
        F.sum("rows").alias("rows"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
        F.sum("squares").alias("squares"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("on_time").alias("on_time"),
    )


def day_cells(txns: DataFrame) -> DataFrame:
    """Cells by customer, day, type, category, series and amount: rows."""
    if "rows" in txns.columns:
        return txns
    return txns.select(*DAY_KEY, F.lit(1).alias("rows"))


def bill_and_investment_days(txns: DataFrame) -> DataFrame:
    """Day cells of investments and bills; all other rows only keep customer and amount, which is
    what a customer's median amount needs."""
    bill = is_debit() & F.col("merchant_category").isin(BILLS) & in_series()
    invested = F.col("merchant_category") == INVESTMENT
    dated = F.coalesce(bill | invested, F.lit(False))
    return day_cells(txns).withColumns({
        "recurring_group_id": F.when(bill, F.col("recurring_group_id")),
        **{name: F.when(dated, F.col(name)) for name in ("date", "type", "merchant_category")},
    })


def combined_days(txns: DataFrame) -> DataFrame:
    """Day cells of investments, bills and other amounts, combined by their whole key."""
    return bill_and_investment_days(txns).groupBy(*DAY_KEY).agg(F.sum("rows").alias("rows"))


class Base:
    """Both cell tables of some transactions, whose rows are written to the shared folder on first
    use.

    Transactions in several tables are read and written one table after the other. With ``parts``
    the rows are dealt by a hash of their customer: ``by_customers`` gives the base of each part.
    """

    def __init__(self, txns: DataFrame | list[DataFrame], parts: int = 1):
        self.txns = txns if isinstance(txns, list) else [txns]
        self.parts = parts

    @cached_property
    def _dealt(self) -> DataFrame:
        by = (PART,) if self.parts > 1 else ()
        part = F.pmod(F.xxhash64("customer_id"), F.lit(self.parts)).cast("int").alias(PART)
        return staged_in_turn(
            self.txns[0].sparkSession, self.txns,
            lambda rows: rows.select(*COLUMNS, *[part for _ in by]), "transactions",
            ROWS_PER_FILE, by)

    @cached_property
    def rows(self) -> DataFrame:
        return self._dealt.select(*COLUMNS)

    @property
    def activity(self) -> DataFrame:
        return activity_cells(self.rows)

    @property
    def days(self) -> DataFrame:
        return bill_and_investment_days(self.rows)

    def _of(self, rows: DataFrame) -> Base:
        """The base of rows that are written already."""
        base = Base(rows)
        base.rows = rows
        return base

    def before(self, day: dt.date) -> Base:
        """The base of the rows before a day, which are not written again."""
        return self._of(self.rows.where(F.col("date") < F.lit(day)))

    def by_customers(self) -> list[Base]:
        """Bases that hold all rows of some customers each, together all rows of this one."""
        if self.parts == 1:
            return [self._of(self.rows)]
        return [self._of(self._dealt.where(F.col(PART) == part).select(*COLUMNS))
                for part in range(self.parts)]
