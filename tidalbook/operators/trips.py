"""Trips and the transactions that paid for them: a bucketed range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..schema import with_defaults
from . import validate, writes

HOURS, MONEY = 2, 2


def candidates(trips: DataFrame, transactions: DataFrame, signed: bool = False) -> DataFrame:
    """Pairs within two hours and 2.00 (bounds included).

    Time and money are cut into buckets twice as wide as their windows; a trip
    looks into its own and one neighbour of each, so the join is on two equal
    keys, and the exact bounds filter what it gives.  ``signed``: compare with
    the signed amount.
    """
    width, coins = 2 * HOURS * 3_600_000, 2 * MONEY

    def around(value: Column, reach: int, width: int) -> Column:
        return F.explode(F.sequence(*(F.floor((value + d) / width).cast("long") for d in (-reach, reach))))

    t = trips.select(F.col("id").alias("trip_id"), F.col("amount").alias("trip_amount"), dates.millis(F.col("date")).alias("trip_ms"))
    t = t.withColumn("bucket", around(F.col("trip_ms"), HOURS * 3_600_000, width)).withColumn("money", around(F.col("trip_amount"), MONEY, coins))
    x = transactions.select(F.col("id").alias("tx_id"), (F.col("amount") if signed else F.abs("amount")).alias("tx_amount"), dates.millis(F.col("date")).alias("tx_ms"))
    x = x.withColumns({"bucket": F.floor(F.col("tx_ms") / width), "money": F.floor(F.col("tx_amount") / coins).cast("long")})
    near = F.abs(F.col("tx_ms") - F.col("trip_ms")) <= HOURS * 3_600_000
    close = F.abs(F.col("tx_amount") - F.col("trip_amount")) <= F.lit(MONEY).cast("decimal(15,2)")
    return t.join(x, ["bucket", "money"]).where(near & close).select("trip_id", "tx_id", "trip_ms", F.abs(F.col("tx_ms") - F.col("trip_ms")).alias("dt"), F.abs(F.col("tx_amount") - F.col("trip_amount")).alias("da"))


#: Cells of cents: each width holds the one before, and a trip's range of money is cut into whole cells of few widths.
WIDTHS = (1, 8, 64)
#: Time is cut into days, of which a trip looks into one or two.
DAY_US = 86_400_000_000
HOURS_US = HOURS * 3_600_000_000


def _cells(low: Column, high: Column) -> Column:
    """The cells that together are the cents from ``low`` to ``high``: as wide as fit, each cent in one."""
    bounds = [(F.ceil(low / w).cast("long"), F.floor((high + 1) / w).cast("long")) for w in WIDTHS]

    def run(level: int, start: Column, end: Column) -> Column:
        cells = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(cells, lambda i: i * len(WIDTHS) + level)

    runs = [run(len(WIDTHS) - 1, *bounds[-1])]
    for level in range(len(WIDTHS) - 1):
        (start, end), (above, below), times = bounds[level], bounds[level + 1], WIDTHS[level + 1] // WIDTHS[level]
        runs += [run(level, start, above * times), run(level, below * times, end)]
    return F.concat(*runs)


def _nearest(t: DataFrame, x: DataFrame) -> DataFrame:
    """``us``, ``cents`` of ``t`` with ``dt``: the milliseconds to the nearest moment in ``x`` within two hours and 2.00.

    A moment of ``x`` lies in one cell of each width.  In a cell and day the
    latest moment before a trip and the first one after it are found in one
    order of time, so the work follows the rows and not the pairs.
    """
    day = lambda us: F.floor(us / DAY_US).cast("int")
    days = F.sequence(day(F.col("us") - HOURS_US), day(F.col("us") + HOURS_US))
    asked = t.withColumn("cell", F.explode(_cells(F.col("cents") - 100 * MONEY, F.col("cents") + 100 * MONEY))).select("cell", F.explode(days).alias("bucket"), "us", "cents")
    homes = F.array(*(F.floor(F.col("cents") / w).cast("long") * len(WIDTHS) + i for i, w in enumerate(WIDTHS)))
    there = x.select(F.explode(homes).alias("cell"), day(F.col("us")).alias("bucket"), "us", F.lit(None).cast("long").alias("cents"))
    order = Window.partitionBy("cell", "bucket").orderBy("us")
    both = there.unionByName(asked).withColumn("x_us", F.when(F.col("cents").isNull(), F.col("us")))
    both = both.withColumns({
        "before": F.max("x_us").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.expr("lead(x_us) ignore nulls over (partition by cell, bucket order by us)"),
    })
    ms = lambda us: F.unix_millis(F.timestamp_micros(us))
    apart = lambda c: F.when(F.abs(F.col(c) - F.col("us")) <= HOURS_US, F.abs(ms(F.col(c)) - ms(F.col("us"))))
    found = both.where("cents is not null").select("us", "cents", F.least(apart("before"), apart("after")).alias("dt"))
    return found.where("dt is not null").groupBy("us", "cents").agg(F.min("dt").alias("dt"))


def match(trips: DataFrame, transactions: DataFrame, signed: bool = False) -> DataFrame:
    """``trip_id``, ``tx_id``: each trip's nearest transaction by time, then amount, then id; amounts are in whole cents.

    Trips of one moment and price have the same one, and of transactions of one
    moment and amount only the smallest id counts, so those are merged first.
    The nearest time is found without pairs; then a trip meets only what stands
    at that time.
    """
    cents = lambda amount: (amount.cast("decimal(15,2)") * 100).cast("long")
    paid = F.col("amount") if signed else F.abs("amount")
    x = transactions.select(F.col("id").alias("tx_id"), dates.micros(F.col("date")).alias("us"), cents(paid).alias("cents")).where("tx_id is not null and us is not null and cents is not null")
    rows = trips.select(F.col("id").alias("trip_id"), dates.millis(F.col("date")).alias("trip_ms"), dates.micros(F.col("date")).alias("us"), cents(F.col("amount")).alias("cents")).where("us is not null and cents is not null")
    coins = 200 * MONEY
    near = _nearest(rows.select("us", "cents").distinct(), x.select("us", "cents").distinct())
    ms = F.unix_millis(F.timestamp_micros("us"))
    asked = near.withColumn("x_ms", F.explode(F.array_distinct(F.array(ms - F.col("dt"), ms + F.col("dt")))))
    asked = asked.withColumn("money", F.explode(F.sequence(*(F.floor((F.col("cents") + d) / coins).cast("long") for d in (-100 * MONEY, 100 * MONEY)))))
    one = x.groupBy(F.col("us").alias("x_us"), F.col("cents").alias("x_cents")).agg(F.min("tx_id").alias("tx_id"))
    one = one.withColumns({"x_ms": F.unix_millis(F.timestamp_micros("x_us")), "money": F.floor(F.col("x_cents") / coins).cast("long")})
    da = F.abs(F.col("x_cents") - F.col("cents"))
    met = asked.join(one, ["x_ms", "money"]).where((F.abs(F.col("x_us") - F.col("us")) <= HOURS_US) & (da <= 100 * MONEY))
    best = met.groupBy("us", "cents", "dt").agg(F.min(F.struct(da.alias("da"), "tx_id")).alias("best"))
    nearest = F.min(F.struct("dt", "best.da", "best.tx_id"))["tx_id"]
    return rows.join(best, ["us", "cents"]).groupBy("trip_id", "trip_ms").agg(nearest.alias("tx_id"))


def link(matched: DataFrame, transactions: DataFrame) -> DataFrame:
    """``transactions`` with trip and category of the latest trip that matched each."""
    last = matched.groupBy("tx_id").agg(F.max_by("trip_id", F.struct("trip_ms", "trip_id")).alias("__trip"))
    joined = transactions.join(last, transactions["id"] == last["tx_id"], "left")
    new = {"uber_metadata_id": F.coalesce("__trip", "uber_metadata_id"), "category": F.when(F.col("__trip").isNotNull(), "transporte").otherwise(F.col("category"))}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in transactions.columns))


def unmatched(trips: DataFrame, matched: DataFrame) -> DataFrame:
    """New ledger rows for trips without a transaction; ``trips`` has origin and destination too."""
    rest = trips.join(matched.select(F.col("trip_id").alias("id")), "id", "left_anti")
    return rest.select(
        text.external_id_trip(dates.millis(F.col("date")), F.col("amount")).alias("external_id"), text.trip_description(F.col("origin"), F.col("destination")).alias("description"),
        (-F.abs("amount")).alias("amount"), F.col("date"), F.lit("transporte").alias("category"), F.lit("uber").alias("source"), F.col("id").alias("uber_metadata_id"),
    )


#: The account of trips that no transaction paid for.
ACCOUNT = "Uber"


def from_payloads(payloads: DataFrame, free: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trip rows of valid payloads (``valor``, ``data_hora``, addresses, driver, seconds), and rejected payloads with their failed fields.

    A trip's id comes from its payload, so a payload that lands twice is one trip.
    ``free``: trips of 0.00 are valid too.
    """
    good, bad = validate.split(payloads, "free_trip" if free else "trip")
    date = F.to_timestamp("data_hora").cast("timestamp_ntz")
    known = F.sha2(F.concat_ws("|", F.col("valor").cast("string"), "data_hora", "endereco_partida", "endereco_destino", F.coalesce("nome_motorista", F.lit(""))), 256)
    rows = good.select(
        known.alias("id"), F.col("valor").cast("decimal(15,2)").alias("amount"), date.alias("date"), F.col("endereco_partida").alias("origin"), F.col("endereco_destino").alias("destination"),
        F.col("nome_motorista").alias("driver"), F.col("duracao_segundos").alias("seconds"),
    )
    return rows.dropDuplicates(["id"]), bad


def metadata(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the trips table."""
    named = {"origin": "origin_address", "destination": "destination_address", "driver": "driver_name", "seconds": "duration_seconds"}
    return with_defaults(rows.withColumnsRenamed(named), "trips", now)


def changes(rows: DataFrame, transactions: DataFrame, accounts: DataFrame, signed: bool = False, now: Column | None = None, free: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What some trips change: the transactions that get a trip, the rows to add for the other trips, and the accounts to add for those.

    ``free``: a trip of 0.00 is no expense, so no row is added for it.
    """
    matched = match(rows, transactions, signed)
    fresh = unmatched(rows.where("amount <> 0") if free else rows, matched).withColumn("name", F.lit(ACCOUNT))
    missing = writes.missing_accounts(fresh, accounts)
    known = accounts.select("id", "name", "created_at").unionByName(missing.select("id", "name", F.col("created_at").cast(accounts.schema["created_at"].dataType).alias("created_at")))
    added = with_defaults(writes.resolve_accounts(fresh, known).drop("name").withColumn("id", F.concat_ws("_", "external_id", "uber_metadata_id")), "transactions", now)
    linked = link(matched, transactions.join(matched.select(F.col("tx_id").alias("id")).distinct(), "id", "left_semi").select(*transactions.columns))
    return linked, added.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in transactions.schema)), missing


def booked(rows: DataFrame, transactions: DataFrame, accounts: DataFrame, signed: bool = False, now: Column | None = None, free: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ledger after some trips: transactions with their trips, and new ones for the rest; and the accounts to add for those.

    ``free``: a trip of 0.00 is no expense, so no row is added for it.
    """
    matched = match(rows, transactions, signed)
    fresh = unmatched(rows.where("amount <> 0") if free else rows, matched).withColumn("name", F.lit(ACCOUNT))
    missing = writes.missing_accounts(fresh, accounts)
    known = accounts.select("id", "name", "created_at").unionByName(missing.select("id", "name", F.col("created_at").cast(accounts.schema["created_at"].dataType).alias("created_at")))
    added = with_defaults(writes.resolve_accounts(fresh, known).drop("name").withColumn("id", F.concat_ws("_", "external_id", "uber_metadata_id")), "transactions", now)
    after = link(matched, transactions)
    added = added.select(*(F.col(c).cast(after.schema[c].dataType).alias(c) for c in after.columns))
    return after.unionByName(added), missing
