import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from tidalbook import schema
from tidalbook.functions import geo
from tidalbook.operators import classify, dedup, places, tables, trips, validate, writes
from tidalbook.sources import events, feeds, ofx

T0 = dt.datetime(2024, 1, 1)


def ledger(spark, rows):
    return spark.createDataFrame(rows, "id string, external_id string, description string, amount decimal(15,2), date timestamp_ntz, category string, updated_at timestamp_ntz, account_id string")


def row(i, key, d="x", amount=1, minutes=0):
    from decimal import Decimal

    return (i, key, d, Decimal(amount), T0 + dt.timedelta(minutes=minutes), "lazer", T0, "a")


def test_upsert_is_idempotent_and_keeps_what_it_should(spark):
    target = ledger(spark, [row("1", "k1"), row("2", None), row("3", "k3")])
    batch = ledger(spark, [row("9", "k1", "new", 5), row("8", "k1", "newer", 6, 3), row("7", None, "n"), row("6", "k6")])
    once = writes.upsert(target, batch)
    got = {r["id"]: r for r in once.collect()}
    assert set(got) == {"1", "2", "3", "7", "6"} and got["1"]["description"] == "newer" and got["1"]["account_id"] == "a"
    keyed = batch.where("external_id is not null")
    assert sorted(map(str, writes.upsert(writes.upsert(target, keyed), keyed).collect())) == sorted(map(str, writes.upsert(target, keyed).collect()))


def test_insert_ignore_takes_the_first_and_all_null_keys(spark):
    batch = ledger(spark, [row("b", "k", minutes=1), row("a", "k"), row("c", None), row("d", None), row("e", "old")])
    assert sorted(r["id"] for r in writes.insert_ignore(batch, ledger(spark, [row("x", "old"), row("y", None)])).collect()) == ["a", "c", "d"]
    empty = ledger(spark, [])
    assert writes.insert_ignore(empty, empty).count() == 0


def test_defaults(spark):
    df = schema.with_defaults(spark.createDataFrame([("A",)], "name string"), "accounts")
    r = df.first()
    assert df.schema.names == schema.ACCOUNTS.names and r["type"] == "banco" and r["balance"] == 0 and r["id"] and r["created_at"]


def test_accounts_resolve_to_the_oldest(spark):
    acc = spark.createDataFrame([("2", "N", T0), ("1", "N", T0), ("0", "N", T0 + dt.timedelta(1))], "id string, name string, created_at timestamp_ntz")
    assert writes.resolve_accounts(spark.createDataFrame([("N",), ("M",)], "name string"), acc).collect()[0]["account_id"] == "1"


def test_forgotten_trips(spark):
    tx = spark.createDataFrame([("1", "t1"), ("2", "t2"), ("3", None)], "id string, uber_metadata_id string")
    got = {r[0]: r[1] for r in writes.forget_trips(tx, spark.createDataFrame([("t1",)], "id string")).select("id", "uber_metadata_id").collect()}
    assert got == {"1": "t1", "2": None, "3": None}


def test_greedy_window(spark):
    rows = [("k", s * 1000) for s in (0, 200, 299, 301, 500, 602)] + [("l", 5)]
    got = dedup.keep_first_in_window(spark.createDataFrame(rows, "k string, ms long"), ["k"], "ms").collect()
    assert sorted((r["k"], r["ms"]) for r in got) == [("k", 0), ("k", 301_000), ("k", 602_000), ("l", 5)]


def test_greedy_window_equals_a_simulation(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(0, 8_000_000)) for _ in range(400)]
    want, last = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in last or t - last[k] > 300_000:
            want.append((k, t))
            last[k] = t
    got = dedup.keep_first_in_window(spark.createDataFrame(rows, "k string, ms long"), ["k"], "ms").collect()
    assert sorted((r["k"], r["ms"]) for r in got) == sorted(want)


def test_range_join_equals_all_pairs(spark):
    from decimal import Decimal

    rng = random.Random(2)
    t = [(f"t{i}", Decimal(rng.randrange(100, 1500)) / 100, T0 + dt.timedelta(seconds=rng.randrange(0, 90_000))) for i in range(60)]
    x = [(f"x{i}", -Decimal(rng.randrange(100, 1500)) / 100, T0 + dt.timedelta(seconds=rng.randrange(0, 90_000))) for i in range(150)]
    x += [("edge", -t[0][1] - 2, t[0][2] + dt.timedelta(hours=2)), ("past", -t[0][1], t[0][2] + dt.timedelta(hours=2, milliseconds=1))]
    kind = "id string, amount decimal(15,2), date timestamp_ntz"
    got = {(r["trip_id"], r["tx_id"]) for r in trips.candidates(spark.createDataFrame(t, kind), spark.createDataFrame(x, kind)).collect()}
    want = {(a, b) for a, m, d in t for b, n, e in x if abs(d - e) <= dt.timedelta(hours=2) and abs(m - abs(n)) <= 2}
    assert got == want and ("t0", "edge") in got
    signed = trips.candidates(spark.createDataFrame(t, kind), spark.createDataFrame(x, kind), signed=True)
    assert {(r["trip_id"], r["tx_id"]) for r in signed.collect()} == {(a, b) for a, m, d in t for b, n, e in x if abs(d - e) <= dt.timedelta(hours=2) and abs(m - n) <= 2}


def joined_rows(plan):
    """The rows that all joins of a plan that has run gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(plan.plan())
    mine = plan.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0
    return mine + sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("signed", [False, True])
def test_nearest_equals_all_pairs(spark, signed):
    """Among all pairs within the exact bounds: the nearest by whole milliseconds, then by amount, then by id."""
    from decimal import Decimal

    rng = random.Random(5)
    money = lambda: Decimal(rng.randrange(-900, 900)) / 100
    when = lambda: T0 + dt.timedelta(seconds=rng.randrange(0, 900) * 60, microseconds=rng.randrange(0, 3) * 400)
    t = [(f"t{i}", abs(money()), when()) for i in range(120)] + [("late", Decimal(700), T0)]
    x = [(f"x{i}", money(), when()) for i in range(200)] + [("past", Decimal(-700), T0 + dt.timedelta(hours=2, microseconds=400)), (None, Decimal(-700), T0), ("none", None, T0)]
    kind = "id string, amount decimal(15,2), date timestamp_ntz"
    got = {(r["trip_id"], r["tx_id"]) for r in trips.match(spark.createDataFrame(t, kind), spark.createDataFrame(x, kind), signed).collect()}
    ms, want = lambda d: (d - T0) // dt.timedelta(milliseconds=1), set()
    for a, m, d in t:
        near = [(abs(ms(d) - ms(e)), abs(m - (n if signed else abs(n))), b) for b, n, e in x if b and n is not None and abs(d - e) <= dt.timedelta(hours=2) and abs(m - (n if signed else abs(n))) <= 2]
        want |= {(a, min(near)[2])} if near else set()
    assert got == want and len(want) > 60 and "late" not in dict(got)


def test_trips_of_one_hour_make_no_pairs(spark):
    """3,000 trips and 3,000 transactions of one hour and about one price, which all match each other."""
    kind = "concat('{0}', id) as id, cast(10 + id % 90 / 100 as decimal(15,2)) as amount, cast(timestamp_micros(1700000000000000 + id * 1000000) as timestamp_ntz) as date"
    df = trips.match(*(spark.sql(f"select {kind.format(c)} from range(3000)") for c in "tx"))
    assert {r["tx_id"][1:] == r["trip_id"][1:] for r in df.collect()} == {True}
    assert joined_rows(df._jdf.queryExecution().executedPlan()) < 20_000


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.OFX").write_text("<ACCTID>7\r\n<LEDGERBAL><BALAMT>12.5</BALAMT><DTASOF>20240102</LEDGERBAL><STMTTRN><TRNAMT>-1<DTPOSTED>20240101<FITID>1<NAME>Uber\r\n<STMTTRN><TRNAMT>2<DTPOSTED>20240101<FITID>2")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.qfx").write_text("  ")
    files = ofx.read_files(spark, str(tmp_path))
    parsed = ofx.parse(files)
    assert files.count() == 1
    p = parsed.first()
    assert (p["acct_id"], float(p["balance"]), p["balance_date"], p["currency"], p["acct_type"]) == ("7", 12.5, "2024-01-02T00:00:00Z", "BRL", "CHECKING")
    got = [(r["external_id"], float(r["amount"]), r["description"]) for r in ofx.transactions(parsed).orderBy("line").collect()]
    assert got == [("ofx_7_1", -1.0, "Uber"), ("ofx_7_2", 2.0, "Sem descrição")]


def test_feed_pages(spark, tmp_path):
    page = {"total": 2, "totalPages": 2, "page": 1, "results": [{"id": "a", "name": "N", "balance": 3.5, "itemId": "i", "bankData": {"transferNumber": "9"}}]}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text(json.dumps(page | {"page": 2, "results": [{"id": "b"}]}))
    assert feeds.read_pages(spark, str(tmp_path), feeds.ACCOUNT).count() == 2
    first = feeds.flat_accounts(feeds.read_pages(spark, str(tmp_path), feeds.ACCOUNT, first_only=True)).collect()
    assert [(r["pluggy_account_id"], float(r["balance"])) for r in first] == [("a", 3.5)]


def test_bad_payloads_give_nulls(spark):
    df = spark.createDataFrame([('{"valor": 3, "data_hora": "x"}',), ("no json",), (None,)], "body string")
    assert [r["valor"] for r in feeds.parse_payload(df, "body", "trip").collect()] == [3.0, None, None]


def test_split_by_rules(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01T00:00:00Z", "a", "b", None), (0.0, "2024-01-01", "", None, -1)], "valor double, data_hora string, endereco_partida string, endereco_destino string, duracao_segundos int")
    good, bad = validate.split(df, "trip")
    assert good.count() == 1 and bad.first()["failed"] == ["valor", "data_hora", "endereco_partida", "endereco_destino", "duracao_segundos"]


def test_demo_and_health(spark):
    accounts, rows = events.demo(spark, T0)
    assert accounts.count() == 2 and accounts.schema.names == schema.ACCOUNTS.names and rows.count() == 34 and rows.schema.names == schema.TRANSACTIONS.names
    per = {r[0]: (r[1], float(r[2])) for r in rows.groupBy("account_id").agg(F.count("*"), F.sum("amount")).collect()}
    assert per == {"acc-0": (9, 2643.3), "acc-1": (25, -2365.19)} and rows.select("category").distinct().count() == 9
    assert sorted(map(str, rows.drop("updated_at").collect())) == sorted(map(str, events.demo(spark, T0)[1].drop("updated_at").collect()))
    assert events.health(spark).first()["status"] == "ok"


def test_long_chain_is_linear(spark):
    """40,000 times a second apart in one chain: one in 301 stays."""
    df = spark.range(40_000).selectExpr("'k' as k", "id * 1000 as ms")
    got = sorted(r["ms"] for r in dedup.keep_first_in_window(df, ["k"], "ms").collect())
    assert got == list(range(0, 40_000_000, 301_000))
    got = sorted(r["ms"] for r in dedup.keep_first_in_window(df, ["k"], "ms", window_ms=1000).collect())
    assert got == list(range(0, 40_000_000, 2000))


def greedy(rows, window_ms=300_000):
    out, last = set(), {}
    for k, t in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] > window_ms:
            out.add((k, t))
            last[k] = t
    return sorted(out, key=str)


@pytest.mark.parametrize("gap", [3, 150])
def test_walked_chains_equal_a_simulation(spark, gap):
    """Keys that pause and keys that don't, times before 1970, repeated rows, null keys, other widths."""
    rng = random.Random(gap)
    rows = []
    for k in ("a", "b", None):
        t = -gap * 150
        for _ in range(300):
            t += rng.choice([1, rng.randrange(1, gap + 1), gap])
            rows.append((k, t))
    rows += [("lone", 5), ("lone", None), ("two", 0), ("two", 101), *rows[:50]]
    df = spark.createDataFrame(rows, "k string, ms long")
    for window, long in ((100, 0), (7, 60), (100, 5000)):
        got = dedup.keep_first_in_window(df, ["k"], "ms", window, long).collect()
        assert sorted(((r["k"], r["ms"]) for r in got), key=str) == greedy(rows, window)


def test_a_key_that_never_pauses_meets_in_no_task(spark):
    """200,000 times of one key: no aggregate gathers its times, and one in 301 stays."""
    df = spark.range(200_000).selectExpr("'k' as k", "1 as n", "id * 1000 as ms")
    got = sorted(r["ms"] for r in dedup.keep_first_in_window(df, ["k", "n"], "ms").collect())
    assert got == list(range(0, 200_000_000, 301_000))


RECEIPTS = [
    (20.0, "2024-01-01T10:00:00.000Z", "A", "B", "Ana", 600), (20.0, "2024-01-01T10:00:00.000Z", "A", "B", "Ana", 600), (50.0, "2024-01-02T10:00:00Z", "C", "D", None, None),
    (0.0, "2024-01-02T10:00:00Z", "C", "D", None, None), (9.0, "yesterday", "", "D", None, -1),
]
RECEIPT = "valor double, data_hora string, endereco_partida string, endereco_destino string, nome_motorista string, duracao_segundos int"


def test_receipts_are_booked(spark):
    rows, bad = trips.from_payloads(spark.createDataFrame(RECEIPTS, RECEIPT))
    assert rows.count() == 2 and sorted(r["failed"] for r in bad.collect()) == [["data_hora", "endereco_partida", "duracao_segundos"], ["valor"]]
    stored = trips.metadata(rows)
    assert stored.schema.names == schema.TRIPS.names and {(r["origin_address"], r["driver_name"], r["duration_seconds"]) for r in stored.collect()} == {("A", "Ana", 600), ("C", None, None)}
    tx = spark.sql("select '1' as id, 'acc' as account_id, 'x' as description, cast(-19 as decimal(15,2)) as amount, timestamp_ntz'2024-01-01 11:00:00' as date, 'lazer' as category, 'ofx' as source, 'k' as external_id, cast(null as string) as uber_metadata_id")
    ac = spark.createDataFrame([("acc", "Banco", T0)], "id string, name string, created_at timestamp")
    after, fresh = trips.booked(rows, tx, ac)
    got = sorted((r["source"], r["category"], float(r["amount"]), r["uber_metadata_id"] is not None, r["description"]) for r in after.collect())
    assert got == [("ofx", "transporte", -19.0, True, "x"), ("uber", "transporte", -50.0, True, "Uber: C → D")]
    assert [r["name"] for r in fresh.collect()] == ["Uber"] and after.where("source = 'uber'").first()["account_id"] == fresh.first()["id"]
    again, none = trips.booked(rows, tx, ac.unionByName(fresh.select("id", "name", "created_at")))
    assert none.count() == 0 and again.count() == 2


def test_free_receipts_link_and_book_nothing(spark):
    """Two trips of 0.00, of which one has a transaction near it, and two of one moment and price, which are two expenses."""
    def trip(valor, day, origin):
        return (valor, f"2024-01-0{day}T10:00:00.000Z", origin, "B", None, None)

    rows, bad = trips.from_payloads(spark.createDataFrame([trip(0.0, 1, "A"), trip(0.0, 2, "A"), trip(9.0, 3, "A"), trip(9.0, 3, "C"), trip(-1.0, 4, "A")], RECEIPT), free=True)
    assert [r["failed"] for r in bad.collect()] == [["valor"]]
    tx = spark.sql("select '1' as id, 'acc' as account_id, 'x' as description, cast(-1.81 as decimal(15,2)) as amount, timestamp_ntz'2024-01-01 11:00:00' as date, 'lazer' as category, 'ofx' as source, 'k' as external_id, cast(null as string) as uber_metadata_id")
    ac = spark.createDataFrame([("acc", "Banco", T0)], "id string, name string, created_at timestamp")
    after, _ = trips.booked(rows, tx, ac, free=True)
    assert sorted((r["category"], float(r["amount"])) for r in after.collect()) == [("transporte", -9.0), ("transporte", -9.0), ("transporte", -1.81)]
    assert after.select("id").distinct().count() == 3
    linked, added, _ = trips.changes(rows, tx, ac, free=True)
    assert [r["id"] for r in linked.collect()] == ["1"] and added.count() == 2


def test_rejected_lines_and_rows(spark):
    text = "<ACCTID>7</ACCTID><STMTTRN><TRNAMT>x<DTPOSTED>20240101<FITID>1\n</STMTTRN><STMTTRN><TRNAMT>2<FITID>2\n</STMTTRN><STMTTRN><TRNAMT>3<DTPOSTED>20240101<FITID>3\n</STMTTRN>"
    parsed = ofx.parse(spark.createDataFrame([("a.ofx", text), ("b.ofx", "nothing")], "file string, content string"))
    assert [(r["line"], r["missing"]) for r in ofx.rejected(parsed).orderBy("line").collect()] == [(0, ["amount"]), (1, ["posted"])]
    assert [r["external_id"] for r in ofx.transactions(parsed).collect()] == ["ofx_7_3"]
    rows = spark.createDataFrame([("a", "k", "d", None, 1.0, "2024-01-01T00:00:00Z"), ("b", "k", "d", None, 1.0, "no date"), (None, "k", "d", None, None, None)], "id string, accountId string, description string, descriptionRaw string, amount double, date string")
    good, bad = feeds.split_rows(feeds.flat_transactions(rows))
    assert [r["external_id"] for r in good.collect()] == ["pluggy_a"] and sorted(r["missing"] for r in bad.collect()) == [["date"], ["external_id", "amount", "date"]]


def test_statement_file_names(spark, tmp_path):
    for n in ("a.oFx", "b.QfX", "c.ofx", "d.ofx.txt", "e.ofy"):
        (tmp_path / n).write_text("<ACCTID>1")
    assert ofx.read_files(spark, str(tmp_path)).count() == 3


def test_items(spark, tmp_path):
    page = {"results": [{"id": "i", "connector": {"id": 1, "name": "B", "type": "PERSONAL_BANK"}, "status": "UPDATED", "createdAt": "2024-01-02T03:04:05.678Z", "error": None}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    r = feeds.flat_items(feeds.read_pages(spark, str(tmp_path), feeds.ITEM)).first()
    assert (r["pluggy_item_id"], r["connector"], r["failed"], r["createdAt"].microsecond) == ("i", "B", False, 678_000)


def test_delete_all_and_roles(spark):
    from tidalbook.plans import search

    tx, ac = writes.delete_all(ledger(spark, [row("1", "k")]), ledger(spark, [row("2", "k")]))
    assert tx.count() == ac.count() == 0 and tx.columns
    chat = spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "user", "b"), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    assert [(r["role"], r["parts"][0]["text"]) for r in search.turns(chat).orderBy("turn").collect()] == [("model", "a"), ("user", "b"), ("user", None)]


def test_counters(spark, tmp_path):
    """Counted in the one pass that writes, which reads the batch once."""
    batch = ledger(spark, [row("1", "k"), row("2", "k"), row("3", "old"), row("4", None), row("4", None)])
    batch.write.parquet(str(tmp_path / "batch"))
    existing = ledger(spark, [row("9", "old"), row("8", "old"), row("7", None)])
    read = spark.read.parquet(str(tmp_path / "batch"))
    taken, seen = tables.counted(writes.marked_imports(read, existing))
    assert taken._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    taken.write.parquet(str(tmp_path / "out"))
    assert tables.counters(seen) == (5, 3, 2)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r["id"] for r in writes.insert_ignore(batch, existing).collect()) == ["1", "4", "4"]
    nothing, seen = tables.counted(writes.marked_imports(ledger(spark, []), existing))
    nothing.write.parquet(str(tmp_path / "none"))
    assert tables.counters(seen) == (0, 0, 0)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_merge_touches_only_its_parts(spark, tmp_path):
    target = ledger(spark, [row(str(i), f"k{i}") for i in range(200)] + [row("n1", None), row("n1", None)])
    table = tables.KeyedTable(spark, str(tmp_path / "t"), target.schema, parts=16).create(target)
    before = files(tmp_path / "t")
    batch = ledger(spark, [row("x", "k7", "new", 5), row("y", "k7", "newer", 6, 3), row("z", "fresh")])
    touched = table.touched(batch)
    assert 0 < len(touched) <= 2 and table.merge(batch) == {"added": 1, "updated": 1}
    after = files(tmp_path / "t")
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("/")[0].removeprefix("part=")) for f in before if f not in same} == set(touched) - ({p for p in touched} - {int(f.split("/")[0].removeprefix("part=")) for f in before})
    assert len(same) >= 14
    assert sorted(map(str, table.read().collect())) == sorted(map(str, writes.upsert(target, batch, order=("date",)).collect()))
    assert table.merge(ledger(spark, [])) == {"added": 0, "updated": 0} and table.read().count() == 203


def test_merge_again_and_after_a_crash(spark, tmp_path, monkeypatch):
    """A batch number that comes again changes nothing, also if the first try died while parts were put in place."""
    import shutil

    target = ledger(spark, [row(str(i), f"k{i}") for i in range(40)])
    table = tables.KeyedTable(spark, str(tmp_path / "t"), target.schema, parts=4).create(target)
    batch = ledger(spark, [row("a", None), row("b", "k3", "new"), row("c", "fresh")])
    first = table.merge(batch, 0)
    want = sorted(map(str, table.read().collect()))
    assert first == {"added": 2, "updated": 1} == table.merge(batch, 0) and sorted(map(str, table.read().collect())) == want
    for part in table.touched(batch):  # what a crash in the middle may leave
        shutil.rmtree(tmp_path / "t" / f"part={part}")
    assert table.merge(batch, 0) == first and sorted(map(str, table.read().collect())) == want
    assert table.merge(batch, 1) == {"added": 1, "updated": 2}  # the row without a key comes again


def test_batch_sink(spark, tmp_path):
    sink = tables.BatchSink(spark, str(tmp_path / "s"), ledger(spark, []).schema)
    assert sink.read().count() == 0
    sink.write(ledger(spark, [row("1", "a"), row("2", "b")]), 0)
    sink.write(ledger(spark, [row("3", "c")]), 1)
    sink.write(ledger(spark, [row("1", "a")]), 0)
    assert sorted((r["id"], r["batch"]) for r in sink.read().collect()) == [("1", 0), ("3", 1)]


def test_null_amounts_do_not_break_aggregates(spark):
    from tidalbook.plans import dashboard

    none = ledger(spark, [])
    r = dashboard.month_trend(none, T0).first()
    assert float(r["income"]) == 0 and r["n"] == 0 and r["income_trend"] == 0
    assert dashboard.total_balance(spark.createDataFrame([], "balance decimal(15,2)")).select(F.col("total_balance").cast("double")).first()[0] == 0


def points(spark, n, wide, middle=(-23.5, -46.6)):
    """``n`` points, evenly over a square of ``wide`` degrees."""
    side = int(n**0.5)
    at = lambda c, i: F.lit(c) + (i / side - 0.5) * wide
    i = F.col("id")
    return spark.range(side * side).select(i.cast("string").alias("id"), F.lit("x").alias("description"), F.lit(1).cast("decimal(15,2)").alias("amount"), at(middle[0], i % side).alias("latitude"), at(middle[1], F.floor(i / side)).alias("longitude"))


def scanned(df):
    """Files and rows that the scan of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.children().isEmpty() or "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.children().head()
        plan = plan.plan() if "QueryStage" in plan.nodeName() else plan
    return int(plan.metrics().apply("numFiles").value()), int(plan.metrics().apply("numOutputRows").value())


@pytest.mark.parametrize("where", [(-23.5, -46.6), (0.0, 180.0), (89.9, 10.0), (-0.001, 0.001), (12.0, -179.999)])
def test_curve_search_equals_the_plain_one(spark, tmp_path, where):
    lat, lng = where
    df = points(spark, 900, 1.5, where).withColumn("longitude", F.when(F.col("longitude") > 180, F.col("longitude") - 360).when(F.col("longitude") < -180, F.col("longitude") + 360).otherwise(F.col("longitude")))
    none = spark.createDataFrame([("n", "x", None, None, None), ("m", "x", None, 1.0, None)], "id string, description string, amount decimal(15,2), latitude double, longitude double")
    df = df.withColumn("latitude", F.least(F.lit(90.0), "latitude")).unionByName(none)
    places.lay_out(df, str(tmp_path / "p"))
    table = places.read(spark, str(tmp_path / "p"), df.schema)
    assert table.count() == df.count()
    for radius, most in ((20_000, 50), (50_000, 7), (50_000, 10_000), (500, 50)):
        plain = geo.nearby(df, lat, lng, radius, most).select("id", "distance_meters").collect()
        assert places.nearby(table, lat, lng, radius, most).select("id", "distance_meters").collect() == plain


def test_curve_search_reads_few_files_as_the_ledger_grows(spark, tmp_path):
    read = {}
    for n, wide in ((4_000, 2.0), (64_000, 8.0)):  # as dense, over sixteen times the area
        df = points(spark, n, wide)
        places.lay_out(df, str(tmp_path / str(n)))
        table = places.read(spark, str(tmp_path / str(n)), df.schema)
        read[n] = scanned(places.within(table, -23.5, -46.6, 5_000))
    files = len(list((tmp_path / "64000").rglob("*.parquet")))
    assert files > 100 and read[64_000][0] <= read[4_000][0] + 2 <= 8 and read[64_000][1] < 64_000 / 50


def test_categories_of_distinct_texts(spark):
    from tidalbook.functions import text

    rows = spark.createDataFrame([("Uber Trip", "old", 1), ("Uber Trip", "old", 2), (None, "old", 3), ("nada", None, 4), ("", None, 5)], "description string, category string, amount int")
    want = sorted(map(str, rows.withColumn("category", text.categorize(F.col("description"))).select("description", "amount", "category").collect()))
    for more in ({}, {"texts": 1}, {"size": 3}):
        got = classify.categorized(rows, **more)
        assert sorted(map(str, got.select("description", "amount", "category").collect())) == want
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (not more)
    totals = {r["category"]: (r["n"], r["total"]) for r in classify.totals_by_category(rows).collect()}
    assert totals == {"transporte": (2, 3), "desconhecido": (3, 12)} and classify.categorized(rows.limit(0)).count() == 0
