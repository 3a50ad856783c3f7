"""Inserts, upserts, updates and deletes as set operations that give the new table.

The engine's tables are plain files, so a mutation is a plan from the old table
and a batch to the new one; callers write it where their table format wants it.
A null key never conflicts with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..schema import with_defaults

#: What an upsert overwrites on a hit; all other columns stay.
OVERWRITTEN = ("description", "amount", "date", "category", "updated_at")


def place_in_key(df: DataFrame, key: str, *order: str, last_first: bool = False) -> DataFrame:
    """``df`` with ``__n``, each row's place within its key in the given order; every row with a null key is a first one.

    Rows with a null key are dealt by a hash of what orders them, so a task that
    runs again deals them alike, and no other column is needed for it.
    """
    alone = F.concat(F.lit("\0"), F.xxhash64(*order).cast("string"))
    keyed = df.withColumn("__key", F.coalesce(F.col(key).cast("string"), alone))
    place = F.row_number().over(Window.partitionBy("__key").orderBy(*(F.col(c).desc() if last_first else F.col(c) for c in order)))
    return keyed.withColumn("__n", F.when(F.col(key).isNull(), 1).otherwise(place)).drop("__key")


def first_per_key(df: DataFrame, key: str, *order: str, last_first: bool = False) -> DataFrame:
    """The first row of each key in the given order; rows with a null key all stay."""
    return place_in_key(df, key, *order, last_first=last_first).where("__n = 1").drop("__n")


def insert_ignore(batch: DataFrame, existing: DataFrame, key: str = "external_id", order: tuple = ("date", "id")) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``existing`` does not have."""
    return first_per_key(batch, key, *order).join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*batch.columns)


def marked_imports(batch: DataFrame, existing: DataFrame, key: str = "external_id", order: tuple = ("date", "id")) -> DataFrame:
    """All rows of ``batch`` with ``imported``: whether ``insert_ignore`` appends them."""
    known = existing.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__known", F.lit(True))
    placed = place_in_key(batch, key, *order).join(known, key, "left")
    return placed.select(*batch.columns, ((F.col("__n") == 1) & F.col("__known").isNull()).alias("imported"))


def upserted(target: DataFrame, batch: DataFrame, key: str = "external_id", order: tuple = ("date", "id"), overwritten: tuple[str, ...] = OVERWRITTEN) -> DataFrame:
    """``target`` after the batch, with ``how`` each row came: ``kept``, ``updated`` or ``added``.

    Hits take the overwritten columns of the batch's last row, other rows are added whole.
    """
    latest = first_per_key(batch, key, *order, last_first=True)
    cols = target.columns
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in cols), F.lit(True).alias("__t"))
    b = latest.select(*((F.col(c) if c in latest.columns else F.lit(None).cast(target.schema[c].dataType)).alias(f"b_{c}") for c in cols), F.lit(True).alias("__b"))
    joined = t.join(b, F.col(f"t_{key}") == F.col(f"b_{key}"), "full")
    hit = F.col("__t") & F.col("__b")
    pick = lambda c: F.when(hit & F.lit(c in overwritten), F.col(f"b_{c}")).when(F.col("__t"), F.col(f"t_{c}")).otherwise(F.col(f"b_{c}"))
    how = F.when(hit, "updated").when(F.col("__t"), "kept").otherwise("added")
    return joined.select(*(pick(c).alias(c) for c in cols), how.alias("how"))


def upsert(target: DataFrame, batch: DataFrame, key: str = "external_id", order: tuple = ("date", "id"), overwritten: tuple[str, ...] = OVERWRITTEN) -> DataFrame:
    """``target`` after the batch; ``tables.KeyedTable`` reads and writes only the parts that a batch touches."""
    return upserted(target, batch, key, order, overwritten).drop("how")


def update_by_key(target: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``target`` with ``columns`` from ``changes`` (one row per key) where they are not null."""
    c = changes.select(F.col(key), *(F.col(x).alias(f"__{x}") for x in columns))
    joined = target.join(c, key, "left")
    return joined.select(*(F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in target.columns))


def missing_accounts(wanted: DataFrame, accounts: DataFrame, key: str = "name") -> DataFrame:
    """New account rows for the keys that ``accounts`` does not have."""
    fresh = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(accounts.select(key), key, "left_anti")
    fresh = fresh if key == "name" else fresh.withColumn("name", F.concat(F.lit("Conta "), F.col(key)))
    # an id that follows from the key, so that a plan that runs again gives the same one
    fresh = fresh if "id" in (key, *fresh.columns) else fresh.withColumn("id", F.sha2(F.concat_ws("|", F.lit("account"), F.col(key).cast("string")), 256))
    return with_defaults(fresh, "accounts")


def resolve_accounts(rows: DataFrame, accounts: DataFrame, key: str = "name") -> DataFrame:
    """``rows`` with ``account_id``: the oldest account of that key, then the smallest id."""
    one = first_per_key(accounts.where(F.col(key).isNotNull()), key, "created_at", "id").select(key, F.col("id").alias("account_id"))
    return rows.join(one, key)


def delete_accounts(accounts: DataFrame, transactions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after deleting accounts by ``id``: their transactions go too."""
    kept = accounts.join(gone.select("id"), "id", "left_anti")
    return kept, transactions.join(kept.select(F.col("id").alias("account_id")), "account_id", "left_semi")


def delete_all(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Tables without rows, to be written over the old ones in this order: first what refers to the others."""
    return tuple(t.limit(0) for t in tables)


def forget_trips(transactions: DataFrame, trips: DataFrame) -> DataFrame:
    """Links to trips that are gone become null."""
    known = trips.select(F.col("id").alias("uber_metadata_id"), F.lit(True).alias("__known"))
    joined = transactions.join(known, "uber_metadata_id", "left")
    return joined.select(*(F.when(F.col("__known"), F.col(c)).alias(c) if c == "uber_metadata_id" else F.col(c) for c in transactions.columns))


def or_default(value: Column, default: object) -> Column:
    return first_filled(value, F.lit(default))
