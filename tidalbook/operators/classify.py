"""Classification of each distinct text once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Distinct texts, and their bytes, up to which classified texts are broadcast.
TEXTS, BYTES = 100_000, 8 << 20


def categorized(rows: DataFrame, column: str = "description", into: str = "category", texts: int = TEXTS, size: int = BYTES) -> DataFrame:
    """``rows`` with ``into``, the category of ``column``; a column of that name is replaced.

    A ledger has far fewer texts than rows.  Distinct texts are counted first:
    up to ``texts`` of ``size`` bytes in all, they are classified and broadcast;
    beyond, each row is classified where it stands, which moves no rows.
    """
    rows = rows.drop(into)
    distinct = rows.select(F.col(column).alias("__text")).distinct()
    n, length = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    if n > texts or length > size:
        return rows.withColumn(into, text.categorize(F.col(column)))
    known = distinct.withColumn(into, text.categorize(F.col("__text")))
    return rows.join(F.broadcast(known), F.col(column).eqNullSafe(F.col("__text")), "left").drop("__text")


def totals_by_category(rows: DataFrame, *keys: str, column: str = "description") -> DataFrame:
    """``keys``, ``category``, ``n`` and ``total`` (of ``amount``): rows are added up by text first, then texts are classified."""
    per_text = rows.groupBy(*keys, column).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    named = per_text.withColumn("category", text.categorize(F.col(column)))
    return named.groupBy(*keys, "category").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
