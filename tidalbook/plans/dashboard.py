"""Dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

MONEY = "decimal(18,2)"


def _sum(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY)


def _two_sides(amount: Column, when: Column, prefix: str = "") -> list[Column]:
    zero = F.lit(0).cast("decimal(15,2)")
    return [
        _sum(F.when(when & (amount > 0), amount).otherwise(zero)).alias(f"{prefix}income"),
        F.abs(_sum(F.when(when & (amount < 0), amount).otherwise(zero))).alias(f"{prefix}expenses"),
        F.count_if(when).alias(f"{prefix}n"),
    ]


def total_balance(accounts: DataFrame) -> DataFrame:
    return accounts.agg(_sum(F.col("balance")).alias("total_balance"))


def month_stats(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    now = F.lit(as_of)
    return ledger.where(dates.in_month(F.col("date"), now)).agg(*_two_sides(F.col("amount"), F.lit(True)))


def trend(now: Column, before: Column) -> Column:
    """Change in percent; with nothing before it is 100 if there is anything now."""
    now, before = now.cast("double"), before.cast("double")
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise((now - before) / F.nullif(before, F.lit(0.0)) * 100)


def month_trend(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """This month and the one before in one pass over two months."""
    now, date = F.lit(as_of), F.col("date")
    two = ledger.where((date >= dates.month_start(now, -1)) & (date < dates.month_start(now, 1)))
    this = date >= dates.month_start(now)
    one = two.agg(*_two_sides(F.col("amount"), this), *_two_sides(F.col("amount"), ~this, "previous_"))
    return one.withColumns({f"{k}_trend": F.round(trend(F.col(k), F.col(f"previous_{k}")), 6) for k in ("income", "expenses")})


def spend_by_category(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    spent = ledger.where(dates.in_month(F.col("date"), F.lit(as_of)) & (F.col("amount") < 0))
    return spent.groupBy("category").agg(F.abs(_sum(F.col("amount"))).alias("total")).where("total > 0")


def spend_rollup(ledger: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Spending by category and, with a null category, in all."""
    spent = ledger.where(dates.in_month(F.col("date"), F.lit(as_of)) & (F.col("amount") < 0))
    return spent.rollup("category").agg(F.abs(_sum(F.col("amount"))).alias("total"))


def recent(ledger: DataFrame, n: int = 10) -> DataFrame:
    return ledger.orderBy(F.desc("date"), "id").limit(n)
