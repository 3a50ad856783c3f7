import datetime as dt
import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidalbook import schema
from tidalbook.operators import dedup, tables
from tidalbook.sources import events
from tidalbook.streaming import ingest


def lines(path, rows):
    path.mkdir(exist_ok=True)
    (path / "part.json").write_text("\n".join(json.dumps(r) for r in rows))


ROWS = [
    {"title": "Nubank", "body": "Compra de R$ 10,00 em PADARIA no valor aprovado", "date": "2024-01-01T10:00:00.000Z"},
    {"title": "Nubank", "body": "Compra de R$ 10,00 em PADARIA no valor aprovado", "date": "2024-01-01T10:00:00.000Z"},
    {"title": "Nubank", "body": "Compra de R$ 12,00 em BAR", "date": "2024-01-01T10:01:00.000Z"},
    {"title": "Outro", "body": "Compra de R$ 12,00", "date": "2024-01-01T10:01:00.000Z"},
    {"title": "Nubank", "body": "bom dia", "date": "2024-01-01T10:01:00.000Z"},
    {"title": None, "body": None, "date": None},
]


def test_stream_equals_batch(spark, tmp_path):
    lines(tmp_path / "in", ROWS)
    stream = ingest.without_repeats(ingest.notifications(events.read_notifications(spark, str(tmp_path / "in"), streaming=True)))
    q = stream.writeStream.format("memory").queryName("notes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["description"], float(r["amount"])) for r in spark.table("notes").collect())
    batch = ingest.notifications(events.read_notifications(spark, str(tmp_path / "in"))).dropDuplicates(["external_id"])
    assert got == sorted((r["description"], float(r["amount"])) for r in batch.collect()) == [("bar", -12.0), ("padaria", -10.0)]


def test_each_batch_upserts(spark, tmp_path):
    lines(tmp_path / "in", ROWS)
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ingest.notifications(events.read_notifications(spark, str(tmp_path / "in"))).schema, parts=3).create()
    for n in range(2):  # the same rows again change nothing
        rows = ingest.notifications(events.read_notifications(spark, str(tmp_path / "in"), streaming=True))
        ingest.into_table(rows, table).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
        assert table.read().count() == 2


def test_stream_of_trips(spark, tmp_path):
    lines(tmp_path / "trips", [{"id": "t1", "amount": 20.0, "date": "2024-01-01T10:00:00"}])
    kind = "id string, amount decimal(15,2), date timestamp_ntz"
    stored = spark.sql("select '1' as id, cast(-19 as decimal(15,2)) as amount, timestamp_ntz'2024-01-01 11:00:00' as date, 'lazer' as category, cast(null as string) as uber_metadata_id")
    out = []
    stream = spark.readStream.schema(kind).json(str(tmp_path / "trips"))
    q = ingest.linked_trips(stream, lambda: stored, lambda df: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["uber_metadata_id"], r["category"]) for r in out] == [("t1", "transporte")]


def test_bad_rows_go_to_the_side(spark, tmp_path):
    """A row that cannot be stored does not stop its batch."""
    kind = "external_id string, description string, amount decimal(15,2), date timestamp, category string"
    lines(tmp_path / "in", [{"external_id": "a", "amount": 1.0, "date": "2024-01-01T00:00:00Z"}, {"external_id": None, "amount": 2.0, "date": "2024-01-01T00:00:00Z"}, {"external_id": "c", "amount": "x"}])
    schema = spark.createDataFrame([], kind).schema
    table = tables.KeyedTable(spark, str(tmp_path / "t"), schema, parts=2).create()
    bad = tables.BatchSink(spark, str(tmp_path / "bad"), spark.createDataFrame([], kind + ", missing array<string>").schema)
    counts = tables.BatchSink(spark, str(tmp_path / "counts"), ingest.MERGED)
    writer = ingest.into_table(spark.readStream.schema(kind).json(str(tmp_path / "in")), table, bad, counts)
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r["external_id"] for r in table.read().collect()] == ["a"]
    assert sorted(tuple(r["missing"]) for r in bad.read().collect()) == [("amount", "date"), ("external_id",)]
    assert [tuple(r) for r in counts.read().collect()] == [(1, 0, 0)]


@pytest.mark.parametrize("dies", [None, "accounts", "ledger"])
def test_receipts_stream_and_restart(spark, tmp_path, dies):
    """Receipts land in two runs of one stream, and a receipt that lands again changes nothing; the first run may die after any of its writes."""
    tx = spark.sql("select '1' as id, 'acc' as account_id, 'x' as description, cast(-19 as decimal(15,2)) as amount, timestamp_ntz'2024-01-01 11:00:00' as date, 'lazer' as category, 'ofx' as source, 'k' as external_id, cast(null as string) as uber_metadata_id")
    ac = spark.createDataFrame([("acc", "Banco", dt.datetime(2024, 1, 1))], "id string, name string, created_at timestamp")
    died = []

    def once(name, done):
        if name == dies and not died:
            died.append(name)
            raise RuntimeError(f"died after {name}")
        return done

    class Table(tables.KeyedTable):
        def merge(self, *args, **more):
            return once(self.path.rsplit("/", 1)[1], super().merge(*args, **more))

    class Sink(tables.BatchSink):
        def write(self, *args):
            return once(self.path.rsplit("/", 1)[1], super().write(*args))

    ledger = Table(spark, str(tmp_path / "ledger"), tx.schema, "id", 4).create(tx)
    accounts = Table(spark, str(tmp_path / "accounts"), ac.schema, "id", 2).create(ac)
    booked = Sink(spark, str(tmp_path / "trips"), schema.TRIPS)
    (tmp_path / "in").mkdir()
    kind = ingest.receipts(spark, str(tmp_path / "in")).schema
    reject = Sink(spark, str(tmp_path / "rejected"), spark.createDataFrame([], kind).withColumn("failed", F.array().cast("array<string>")).schema)

    def run():
        writer = ingest.booked_receipts(ingest.receipts(spark, str(tmp_path / "in")), ledger, accounts, booked, reject, every=None).option("checkpointLocation", str(tmp_path / "cp"))
        try:
            writer.start().awaitTermination()
        except StreamingQueryException:
            writer.start().awaitTermination()

    one = {"valor": 20.0, "data_hora": "2024-01-01T10:00:00Z", "endereco_partida": "A", "endereco_destino": "B"}
    lines(tmp_path / "in", [one, {"valor": -1.0}, one | {"valor": 90.0}])
    run()
    rows = lambda: sorted((r["source"], r["category"], float(r["amount"])) for r in ledger.read().collect())
    assert rows() == [("ofx", "transporte", -19.0), ("uber", "transporte", -90.0)] and len(died) == (dies is not None)
    assert booked.read().count() == 2 and reject.read().count() == 1 and sorted(r["name"] for r in accounts.read().collect()) == ["Banco", "Uber"]
    (tmp_path / "in" / "more.json").write_text("\n".join(json.dumps(x) for x in (one, one | {"valor": 70.0})))
    run()
    run()  # nothing new
    assert rows() == [("ofx", "transporte", -19.0), ("uber", "transporte", -90.0), ("uber", "transporte", -70.0)]
    assert booked.read().count() == 3 and accounts.read().count() == 2
    assert {r["account_id"] for r in ledger.read().where("source = 'uber'").collect()} == {r["id"] for r in accounts.read().where("name = 'Uber'").collect()}


def test_free_receipts_on_a_stream(spark, tmp_path):
    """A receipt of 0.00 links its transaction and books nothing; two trips of one moment and price are two rows."""
    tx = spark.sql("select '1' as id, 'acc' as account_id, 'x' as description, cast(-1.81 as decimal(15,2)) as amount, timestamp_ntz'2024-01-01 11:00:00' as date, 'lazer' as category, 'ofx' as source, 'k' as external_id, cast(null as string) as uber_metadata_id")
    ac = spark.createDataFrame([("acc", "Banco", dt.datetime(2024, 1, 1))], "id string, name string, created_at timestamp")
    free = {"valor": 0.0, "data_hora": "2024-01-01T10:00:00Z", "endereco_partida": "A", "endereco_destino": "B"}
    paid = free | {"valor": 90.0}
    lines(tmp_path / "in", [free, free | {"data_hora": "2024-01-09T10:00:00Z"}, paid, paid | {"endereco_partida": "C"}])
    kind = ingest.receipts(spark, str(tmp_path / "in")).schema
    ledger, accounts = tables.KeyedTable(spark, str(tmp_path / "ledger"), tx.schema, "id", 4).create(tx), tables.KeyedTable(spark, str(tmp_path / "accounts"), ac.schema, "id", 2).create(ac)
    reject = tables.BatchSink(spark, str(tmp_path / "rejected"), spark.createDataFrame([], kind).withColumn("failed", F.array().cast("array<string>")).schema)
    booked = tables.BatchSink(spark, str(tmp_path / "trips"), schema.TRIPS)
    writer = ingest.booked_receipts(ingest.receipts(spark, str(tmp_path / "in")), ledger, accounts, booked, reject, every=None, free=True)
    writer.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted((r["category"], float(r["amount"])) for r in ledger.read().collect()) == [("transporte", -90.0), ("transporte", -90.0), ("transporte", -1.81)]
    assert booked.read().count() == 4 and reject.read().count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_window_on_a_stream_equals_the_batch(spark, tmp_path, seed):
    """Rows arrive in any order within the delay, over several runs of the stream."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 4_000_000), i) for i in range(150)]
    rows += [(k, t, i + 500) for i, (k, t, _) in enumerate(rows[:20])]
    arrive = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 500_000))
    kind = "k string, date timestamp, n int"
    moment = lambda ms: (dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"
    (tmp_path / "in").mkdir()
    for i in range(0, 171, 57):
        part = [{"k": k, "date": moment(t), "n": n} for k, t, n in arrive[i : i + 57]] + [{"k": "x", "date": None}]
        if i + 57 > 170:
            part.append({"k": "end", "date": moment(99_000_000)})
        (tmp_path / "in" / f"{i:03}.json").write_text("\n".join(map(json.dumps, part)))
        stream = ingest.first_in_window(spark.readStream.schema(kind).json(str(tmp_path / "in")), ["k"], delay="10 minutes")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    got = spark.read.schema(kind).parquet(str(tmp_path / "out")).where("k is null or k <> 'end'")
    assert got.schema.simpleString() == "struct<k:string,date:timestamp,n:int>"
    batch = dedup.keep_first_in_window(spark.createDataFrame([r[:2] for r in rows], "k string, ms long"), ["k"], "ms")
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    mine = sorted((str(r["k"]), r["ms"] - base) for r in got.select("k", F.unix_millis("date").alias("ms")).collect())
    assert mine == sorted((str(r["k"]), r["ms"]) for r in batch.collect()) and len(mine) > 20
    assert got.where("n is null").count() == 0


def test_keys_share_the_calls(spark, tmp_path):
    """20,000 keys, each with two rows of which one stays: the state has as many rows as there are groups, not keys."""
    kind = "k string, n long, date timestamp"
    rows = spark.range(40_000).selectExpr("concat('k', id % 20000) as k", "cast(null as bigint) as n", "timestamp_seconds(1700000000 + id div 20000 * 100) as date")
    end = spark.sql("select 'end' as k, 1L as n, timestamp_seconds(1800000000) as date")
    for part in (rows, end):
        part.write.mode("append").json(str(tmp_path / "in"), timestampFormat=ingest.EXACT)
        kept = ingest.first_in_window(spark.readStream.schema(kind).json(str(tmp_path / "in")), ["k", "n"], groups=16)
        q = kept.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        q.awaitTermination()
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 16 for p in q.recentProgress)
    got = spark.read.schema(kind).parquet(str(tmp_path / "out")).where("k <> 'end'")
    assert got.count() == got.select("k").distinct().count() == 20_000
    assert [r["date"].timestamp() for r in got.select("date").distinct().collect()] == [1_700_000_000]
