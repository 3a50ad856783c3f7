"""Planned features that go beyond the ledger's present queries: balances over time, spending alerts, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

MONEY = "decimal(18,2)"


def balance_over_time(ledger: DataFrame) -> DataFrame:
    """``account_id``, ``day``, ``change``, ``balance``: the running sum of each account's days."""
    days = ledger.groupBy("account_id", dates.iso_day(F.col("date")).alias("day")).agg(F.sum("amount").cast(MONEY).alias("change"))
    so_far = Window.partitionBy("account_id").orderBy("day")
    return days.withColumn("balance", F.sum("change").over(so_far).cast(MONEY))


def spend_alerts(ledger: DataFrame, factor: float = 2.0) -> DataFrame:
    """Expenses above ``factor`` times the mean expense of their category; the means are joined, so no task holds a category."""
    spent = ledger.where("amount < 0").select("id", "category", (-F.col("amount")).alias("spent"))
    mean = spent.groupBy("category").agg((F.sum("spent").cast("double") / F.count("*")).alias("mean"))
    # at most one row for each of the ledger's categories
    return spent.join(F.broadcast(mean), "category").where(F.col("spent").cast("double") > factor * F.col("mean")).select("id", "category", "spent", "mean")


def over_budget(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """Months and categories that spent more than ``budgets`` (``category``, ``budget``) allows."""
    months = ledger.where("amount < 0").groupBy("category", F.date_format("date", "yyyy-MM").alias("month")).agg((-F.sum("amount")).cast(MONEY).alias("spent"))
    return months.join(budgets, "category").where("spent > budget").select("category", "month", "spent", "budget")
