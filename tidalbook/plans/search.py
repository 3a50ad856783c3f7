"""Search with optional arguments, and the filters, orders and pages of the browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

TOP, PAGE = 20, 8


def predicates(description: str | None = None, category: str | None = None, min_amount=None, max_amount=None, start: str | None = None, end: str | None = None) -> list[Column]:
    """One predicate per argument that is given; 0 is an amount.  ``end`` is midnight, so its day is out but for 00:00:00."""
    money = lambda x: F.lit(str(x)).cast("decimal(15,2)")
    out = []
    if description is not None:
        out.append(F.col("description").ilike(f"%{description}%"))
    if category is not None:
        out.append(F.col("category") == category)
    if min_amount is not None:
        out.append(F.col("amount") >= money(min_amount))
    if max_amount is not None:
        out.append(F.col("amount") <= money(max_amount))
    if start is not None:
        out.append(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out.append(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    return out


def filtered(ledger: DataFrame, **args) -> DataFrame:
    for p in predicates(**args):
        ledger = ledger.where(p)
    return ledger


def with_account(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``account_name``; Spark broadcasts the accounts under its size threshold."""
    return ledger.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name")), "account_id", "left")


def search(ledger: DataFrame, accounts: DataFrame, top: int = TOP, **args) -> DataFrame:
    """The oldest ``top`` matches with their account."""
    first = filtered(ledger, **args).orderBy("date", "id").limit(top)
    return with_account(first, accounts).orderBy("date", "id").select("id", "description", F.col("amount").cast("double").alias("amount"), dates.iso_day(F.col("date")).alias("date"), "category", "source", "account_name")


def payload(found: DataFrame) -> DataFrame:
    """The answer of a search as one JSON row: at most ``TOP`` rows are gathered."""
    rows = F.array_sort(F.collect_list(F.struct("date", "id", "description", "amount", "category", "source", "account_name")))
    return found.agg(F.count("*").alias("count"), F.to_json(rows).alias("transactions"))


def browse(ledger: DataFrame, query: str = "", category: str = "", first: str = "", last: str = "") -> DataFrame:
    """The browser's filters; ``last`` ends one second before midnight, that second excluded."""
    if query:
        ledger = ledger.where(F.contains(F.lower("description"), F.lit(query.lower())))
    if category:
        ledger = ledger.where(F.col("category") == category)
    if first:
        ledger = ledger.where(F.col("date") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        ledger = ledger.where(F.col("date") < F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    return ledger


def ordered(ledger: DataFrame, by: str = "date", descending: bool = True) -> DataFrame:
    key = F.collate(F.col(by), "pt") if by == "description" else F.col(by)
    return ledger.orderBy(key.desc() if descending else key.asc(), "id")


def cuts(ledger: DataFrame, by: str = "date", rows: int = 10_000) -> list:
    """Values of ``by`` that cut the ledger into ranges of about ``rows`` rows, ascending: one number or moment each on the driver."""
    n = ledger.count()
    some = min(10_000, n // rows)
    at = F.percentile_approx(by, F.array(*(F.lit(i / (some + 1)) for i in range(1, some + 1))), 100 * (some + 1)) if some else F.array()
    return sorted(set(ledger.agg(at.alias("c")).first()["c"] or []))


def after(ledger: DataFrame, last: tuple | None, by: str = "date", descending: bool = True, size: int = PAGE, known: list | None = None) -> DataFrame:
    """The page that follows the row ``last`` (its value of ``by``, and its id) in the order of ``ordered``; the first page if that is None.

    Where ``offset`` sorts and passes over all earlier pages, this starts at
    ``last`` and, with ``known`` (from ``cuts``), ends at the next cut that leaves
    enough rows, so that of a table in the order of ``by`` the scan reads about
    one range, for whatever page.  Rows without a value come last, if descending.
    """
    if by == "description":
        raise ValueError("texts are ordered by a collation, which no range of a scan follows; use page()")
    key = F.col(by)
    if last is not None:
        value, id_ = last
        if value is None:
            ledger = ledger.where(key.isNull() & (F.col("id") > id_)) if descending else ledger.where(key.isNotNull() | (F.col("id") > id_))
        else:
            beyond = (key < F.lit(value)) if descending else (key > F.lit(value))
            bound = (key <= F.lit(value)) if descending else (key >= F.lit(value))  # says less, but the scan can use it
            rest = beyond | ((key == F.lit(value)) & (F.col("id") > id_))
            ledger = ledger.where((bound & rest) | key.isNull()) if descending else ledger.where(bound & rest)
    order = [key.desc(), F.col("id")] if descending else [key.asc(), F.col("id")]
    at = None if last is None else last[0]
    for cut in (reversed(known) if descending else known) if known and (last is None or at is not None) else []:
        if at is not None and (cut >= at if descending else cut <= at):
            continue
        near = ledger.where((key >= F.lit(cut)) if descending else (key <= F.lit(cut)) | key.isNull())  # all that comes first
        if near.limit(size).count() == size:
            return near.orderBy(*order).limit(size)
    return ledger.orderBy(*order).limit(size)


def page(rows: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    return rows.offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = PAGE) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("n"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("pages"))


def turns(conversations: DataFrame) -> DataFrame:
    """Conversation turns as a language model takes them: the assistant is the model, everybody else the user."""
    role = F.when(F.col("role") == "assistant", "model").otherwise("user")
    return conversations.select("conv_id", "turn", role.alias("role"), F.array(F.struct(F.col("text"))).alias("parts"))
