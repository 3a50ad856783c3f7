"""Continuous ingestion: notifications, window dedup, upserts and trip matching."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators import tables, trips, writes
from ..operators.dedup import WINDOW_MS
from ..sources.events import notification_rows
from ..session import scratch
from ..sources.feeds import PAYLOADS, split_rows

#: Moments in JSON, to the microsecond.
EXACT, EXACT_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: What ``into_table`` counts.
MERGED = tables.numbers("added", "updated")


def notifications(events: DataFrame) -> DataFrame:
    """Ledger rows of purchase notifications with the hash that tells repeats."""
    rows = notification_rows(events)
    key = text.dedup_hash(F.col("amount"), F.col("bank"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return rows.select(key.alias("external_id"), "description", (-F.abs("amount")).alias("amount"), "date", F.lit("desconhecido").alias("category"), F.lit("notification").alias("source"), "bank")


def without_repeats(rows: DataFrame, delay: str = "5 minutes", event_time: str = "date") -> DataFrame:
    """One row per ``external_id`` within the watermark delay at least."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["external_id"])


def first_in_window(rows: DataFrame, keys: list[str], event_time: str = "date", delay: str = "5 minutes", window_ms: int = WINDOW_MS, groups: int = 1_024) -> DataFrame:
    """The rows that ``operators.dedup.keep_first_in_window`` keeps, on a stream: a row within the window after its key's last kept one goes.

    Rows wait in the state until the watermark has passed them, as an
    earlier one may still arrive; so the result is the batch's in whatever order
    rows arrive within ``delay``.  Rows of one key and time: the first by their
    text as JSON stays.  Of a key the state holds its last kept time and the rows
    of the delay; they go when the window has passed.  Later rows, and rows
    without a time, are dropped.

    Keys are dealt over ``groups`` by a hash, and the keys of a group share one
    state and one call, as a call costs far more than a row.  The stream's owner
    sizes ``groups`` so that the rows of a batch make some MB a group; a stream
    keeps its number.

    Spark has no built-in form of such state, so this runs Python workers, which
    get rows in Arrow batches; ``without_repeats`` needs none, but keeps more
    rows than the rule says.
    """
    timed = rows.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    whole = F.to_json(F.struct(*rows.columns), {"timestampFormat": EXACT, "timestampNTZFormat": EXACT_NTZ}).alias("row")
    key = F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))), {"timestampFormat": EXACT, "timestampNTZFormat": EXACT_NTZ}).alias("key")
    told = timed.select(key, F.col(event_time).alias("at"), F.unix_millis(F.col(event_time).cast("timestamp")).alias("ms"), whole)
    told = told.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, lasts, owners, ms, texts = state.get if state.exists else ([], [], [], [], [])
        last = dict(zip(kept, lasts, strict=True))
        waiting = list(zip(ms, texts, owners, strict=True))
        for f in frames:
            waiting += zip(f["ms"].tolist(), f["row"].tolist(), f["key"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        out = []
        ready = bisect_right(waiting, passed, key=lambda w: w[0])
        for t, row, k in waiting[:ready]:
            if k not in last or t - last[k] > window_ms:
                last[k] = t
                out.append(row)
        waiting = waiting[ready:]
        needed = {k for _, _, k in waiting}
        last = {k: t for k, t in last.items() if t + window_ms >= passed or k in needed}
        if waiting or last:
            state.update((list(last), list(last.values()), [k for _, _, k in waiting], [t for t, _, _ in waiting], [r for _, r, _ in waiting]))
            state.setTimeoutTimestamp(max(passed + 1, waiting[0][0] if waiting else min(last.values()) + window_ms + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"row": out})

    kept = told.groupBy("group").applyInPandasWithState(step, "row string", "keys array<string>, lasts array<long>, owners array<string>, ms array<long>, rows array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("row", rows.schema, {"timestampFormat": EXACT, "timestampNTZFormat": EXACT_NTZ}).alias("r")).select("r.*")


def into_table(rows: DataFrame, table: tables.KeyedTable, reject: tables.BatchSink | None = None, counts: tables.BatchSink | None = None) -> DataStreamWriter:
    """Upserts each micro-batch into the parts of the table that it touches.

    With ``reject``, rows without key, amount or date go there, with what is
    missing, and the batch goes on without them.  With ``counts``, each batch
    leaves the numbers of rows it ``added`` and ``updated``.  A batch that runs
    again, as after a crash before its commit, changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if reject is not None:
            batch, bad = split_rows(batch, (table.key, "amount", "date"))
            reject.write(bad, batch_id)
        done = table.merge(batch, batch_id)
        if counts is not None:
            counts.write(batch.sparkSession.createDataFrame([(done["added"], done["updated"])], MERGED), batch_id)

    return rows.writeStream.foreachBatch(step)


def imported(rows: DataFrame, existing: Callable[[], DataFrame], into: tables.BatchSink, counts: tables.BatchSink, key: str = "external_id", order: tuple = ("date",)) -> DataStreamWriter:
    """Appends what each micro-batch has that is new, counted in the pass that writes it.

    What ``into`` has from the batch's own number does not count as known: that is an earlier try of the same batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        known = existing().select(key).union(into.read().where(F.col("batch") != batch_id).select(key))
        taken, seen = tables.counted(writes.marked_imports(batch, known, key, order))
        into.write(taken, batch_id)
        counts.write(batch.sparkSession.createDataFrame([tables.counters(seen)], tables.COUNTERS), batch_id)

    return rows.writeStream.foreachBatch(step)


def linked_trips(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Matches each micro-batch of trips with the stored transactions and links them."""

    def step(batch: DataFrame, _: int) -> None:
        stored = read()
        write(trips.link(trips.match(batch, stored), stored))

    return stream.writeStream.foreachBatch(step)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Landed trip receipts, a JSON payload a line, as a stream."""
    return spark.readStream.schema(PAYLOADS["trip"]).json(path)


def booked_receipts(stream: DataFrame, ledger: tables.KeyedTable, accounts: tables.KeyedTable, booked: tables.BatchSink, reject: tables.BatchSink, every: str | None = "15 minutes", free: bool = False) -> DataStreamWriter:
    """Books each micro-batch of receipts in ``ledger`` and ``accounts``, tables keyed by id; their trips go to ``booked``, bad receipts to ``reject``.

    Only the parts of the ledger that a batch changes are written.  A receipt
    that an earlier batch has booked is not booked again; a batch that runs
    again, wherever its first try ended, leaves what one run leaves: its trips
    are those of no other batch, accounts come before the rows that name them,
    and the tables know the batch's number.  Runs ``every`` so often, or once
    over what has landed if that is None.  ``free``: receipts of 0.00 are good,
    and link what they match, but book no expense.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, bad = trips.from_payloads(batch, free)
        known = booked.read().where(F.col("batch") != batch_id).select("id")
        rows = rows.join(known, "id", "left_anti")
        booked.write(trips.metadata(rows), batch_id)
        linked, added, missing = trips.changes(rows, ledger.read(), accounts.read(), free=free)
        # written before the tables change that they are made from
        path = scratch(spark, "booked")
        linked.unionByName(added).write.parquet(path)
        accounts.merge(missing, batch_id, order=("id",), overwritten=())
        ledger.merge(spark.read.schema(linked.schema).parquet(path), batch_id, order=("date",), overwritten=("category", "uber_metadata_id"))
        reject.write(bad, batch_id)

    writer = stream.writeStream.foreachBatch(step)
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
