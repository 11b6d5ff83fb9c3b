"""Column expressions shared by the feature operators. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    return F.year(date) * 12 + F.month(date) - 1


def month_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), index % 12 + 1, F.lit(1))


def money(value: Column) -> Column:
    return F.round(value, 2).cast("double")


def ratio(value: Column) -> Column:
    """Four decimals; adding zero turns -0.0 into 0.0."""
    return F.round(value, 4) + F.lit(0.0)


def safe_divide(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """``top / bottom`` where ``bottom`` is positive, else a constant."""
    quotient = F.try_divide(top.cast("double"), bottom.cast("double"))
    return F.when(bottom > 0, quotient).otherwise(F.lit(otherwise))


def middle(values: Column) -> Column:
    """Interpolated median of an array. Decimals stay exact."""
    ordered = F.array_sort(values)
    size = F.size(ordered)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return (low + high) / 2


def spread(values: Column, size: Column) -> Column:
    """Sample standard deviation of a short array of doubles."""
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / size
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(squares, (size - 1).cast("double")))


def trend_over_mean(n: Column, first: Column, total: Column, moment: Column) -> Column:
    """Least-squares slope of a gap-filled monthly series, divided by its mean.

    With x = 0..n-1 and zeros in the gaps only two sums over the months that do occur are
    needed: ``total`` = sum(y) and ``moment`` = sum(month_index * y). Both are exact decimals,
    so no month rows have to be generated for the empty months.
    """
    shifted = moment - first * total
    lean = (shifted * 2 - (n - 1) * total).cast("double")
    slope = F.try_divide(lean * 6, (n * n - 1).cast("double") * total.cast("double"))
    return F.when(total > 0, slope).otherwise(F.lit(0.0))


def completeness(months: Column, ideal: int = 12) -> Column:
    return F.round(F.least(F.lit(1.0), months / F.lit(float(ideal))), 4)


def is_credit() -> Column:
    return F.col("type") == "credit"


def is_debit() -> Column:
    return F.col("type") == "debit"


def in_series() -> Column:
    """A recurring group id that is neither missing nor blank."""
    return F.coalesce(F.col("recurring_group_id"), F.lit("")) != ""


def fixed(value: Column, digits: int) -> Column:
    """A number printed with exactly ``digits`` decimals."""
    return value.cast(f"decimal(38,{digits})").cast("string")


def txn_id(customer: Column, date: Column, amount: Column, category: Column, kind: Column,
           merchant: Column) -> Column:
    """Content id of a transaction: 16 hex digits of SHA-256 over its raw cells."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parts = [blank(customer), blank(date), fixed(amount, 2), blank(category), blank(kind),
             blank(merchant)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def spread_of(n: Column, total: Column, squares: Column) -> Column:
    """``n`` times the squares less the squared total of exact decimals, as a double.

    Divided by n (n - 1) it is the sample variance.
    """
    wide = "decimal(38,4)"
    product = n.cast("decimal(10,0)") * squares.cast(wide)
    narrow = total.cast("decimal(19,2)")
    return (product.cast(wide) - (narrow * narrow).cast(wide)).cast("double")
