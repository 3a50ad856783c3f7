"""Golden cases of texts and sources, and landed files."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidalbook.functions import dates, text
from tidalbook.operators import validate
from tidalbook.plans import examples, search
from tidalbook.sources import feeds, ofx

from .test_operators import scanned


def one(spark, rows, make, kind="text string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [r[1] for r in df.select("i", make().alias("x")).orderBy("i").collect()]


AMOUNTS = [("R$ 1.234,56", 1234.56), ("-1.234,5", -1234.5), ("1234,56", 1234.56), ("1234.56", 1234.56), ("1.234", None), ("1,234.56", None), ("Compra de R$ 10,00", None), ("", None), ("R$ -7,1", -7.1), ("12", 12.0)]
TOKENS = [("Compra aprovada de R$ 1.234,56 em PADARIA", 1234.56), ("Pagamento 59,90 no valor", 59.9), ("sem valor", None), ("R$ 15 em loja", 15.0)]
TAGS = [("<NAME> Loja </NAME>", "Loja"), ("<name>Loja\n<MEMO>x", "Loja"), ("<MEMO>x", ""), ("<NAME></NAME>", "")]
BLOCKS = [("<T>a</T>x<t>b</t>", ["a", "b"]), ("h<T>a<T>b", ["a", "b"]), ("none", [])]
MOMENTS = [("20240115120000[-03:BRT]", "2024-01-15T12:00:00-03:00"), ("20240115", "2024-01-15T00:00:00Z"), ("20240115120000.000", "2024-01-15T12:00:00Z"), ("2024011512[5:X]", "2024-01-15T12:00:00+05:00"), ("2024", "now")]


@pytest.mark.parametrize(
    ("cases", "make"),
    [
        (AMOUNTS, lambda: text.parse_amount(F.col("text")).cast("double")), (TOKENS, lambda: text.extract_amount(F.col("text")).cast("double")), (TAGS, lambda: text.tag_value(F.col("text"), "NAME")),
        (BLOCKS, lambda: text.tag_blocks(F.col("text"), "T")), (MOMENTS, lambda: dates.parse_ofx_date(F.col("text"), F.lit("now"))), (sorted(examples.EXAMPLES.items()), lambda: text.categorize(F.col("text"))),
    ],
)
def test_texts(spark, cases, make):
    assert one(spark, [c[:1] for c in cases], make) == [c[1] for c in cases]


HEARD = [
    ("Nubank", "Compra de R$ 10,00 em PADARIA SOL no valor aprovado", "Nubank", True, "padaria sol"), ("Aviso", "Internet fora do ar", "Inter", False, "Internet fora do ar"),
    ("Itaú", "PIX ENVIADO de R$ 5,00", "Itaú", True, "PIX ENVIADO de R$ 5,00"), ("Loja", "Promoção em tudo", None, False, "tudo"), (None, "Cartão C6 utilizado em POSTO r$ 99,00", "C6 Bank", True, "posto"),
]


def test_notifications(spark):
    title, body = F.col("title"), F.col("body")
    made = lambda: F.struct(text.detect_bank(title, body), text.is_purchase(title, body), text.extract_merchant(body))
    assert [tuple(r) for r in one(spark, [h[:2] for h in HEARD], made, "title string, body string")] == [h[2:] for h in HEARD]


STATEMENT = """<OFX><BANKID>341</BANKID><ACCTID>99-1</ACCTID><CURDEF>BRL
<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240115120000[-03:BRT]<TRNAMT>-1,050.25<FITID>f1<NAME>iFood</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20240116<TRNAMT>70.5<FITID>f2<MEMO>Salario</STMTTRN>
<STMTTRN><DTPOSTED>20240116<TRNAMT>1<NAME>no id</STMTTRN>
<STMTTRN><DTPOSTED>20240117<TRNAMT>-50,00<FITID>f3</STMTTRN>
<STMTTRN><DTPOSTED>20240117<TRNAMT>abc<FITID>f4</STMTTRN>
<AVAILBAL><BALAMT>1000.10<DTASOF>20240131</AVAILBAL></OFX>"""
LINES = [("ofx_99-1_f1", "iFood", -1050.25, "2024-01-15T12:00:00-03:00", 1000.1), ("ofx_99-1_f2", "Salario", 70.5, "2024-01-16T00:00:00Z", 1000.1), ("ofx_99-1_f3", "Sem descrição", -5000.0, "2024-01-17T00:00:00Z", 1000.1)]


def test_statement(spark):
    parsed = ofx.parse(spark.createDataFrame([("x.ofx", STATEMENT.replace("\n", "\r\n"))], "file string, content string"))
    got = ofx.transactions(parsed).join(parsed.select("file", "balance"), "file").orderBy("line").collect()
    assert [(r["external_id"], r["description"], float(r["amount"]), r["date"], float(r["balance"])) for r in got] == LINES


def test_statements_in_records_equal_whole_files(spark, tmp_path):
    """Files of all forms, cut into many small splits; lines open and closed, balances before, between and after."""
    rng = random.Random(8)
    line = lambda i, end: f"<STMTTRN>\r\n<TRNTYPE>{rng.choice(['DEBIT', 'CREDIT'])}\r\n<DTPOSTED>202401{i % 28 + 1:02}\r\n<TRNAMT>{rng.randrange(-999, 999)}.5\r\n" + (f"<FITID>f{i}\r\n" if i % 7 else "") + f"<NAME>Loja {i}\r\n{end}"
    head, bal = "<OFX><BANKID>1<ACCTTYPE>SAVINGS\r\n<ACCTID>{a}\r\n", "<LEDGERBAL><BALAMT>12.5\r\n<DTASOF>20240102\r\n</LEDGERBAL>"
    (tmp_path / "a.ofx").write_text(head.format(a="A") + "".join(line(i, "</STMTTRN>\r\n") for i in range(3000)) + bal + "</OFX>")
    (tmp_path / "b.QFX").write_text(head.format(a="B") + bal + "".join(line(i, "") for i in range(500)))
    (tmp_path / "c.ofx").write_text(line(1, "</STMTTRN>") + line(2, "</stmttrn>") + "<ACCTID>C</ACCTID><AVAILBAL><BALAMT>1<DTASOF>20240103</AVAILBAL>")
    (tmp_path / "d.ofx").write_text("<OFX><ACCTID>D</ACCTID></OFX>")
    (tmp_path / "e.ofx").write_text("<STMTTRN><FITID>1<DTPOSTED>20240101<TRNAMT>3")
    (tmp_path / "f.txt").write_text(line(1, ""))
    whole = ofx.parse(ofx.read_files(spark, str(tmp_path)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = ofx.read_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 10
        made = ofx.lines(records)
        base = lambda f: f.rsplit("/", 1)[1]
        mine = sorted((base(r["file"]), r["external_id"], r["description"], r["amount"], r["date"], r["type"]) for r in made.where(F.size("missing") == 0).collect())
        want = sorted((base(r["file"]), r["external_id"], r["description"], r["amount"], r["date"], r["type"]) for r in ofx.transactions(whole).collect())
        assert mine == want and len(mine) == 3000 - 429 + 500 - 72 + 2 + 1
        assert sorted((base(r["file"]), r["fit"], r["missing"]) for r in made.where(F.size("missing") > 0).select("file", F.lit("").alias("fit"), "missing").collect()) == sorted((base(r["file"]), r["fit_id"], r["missing"]) for r in ofx.rejected(whole).collect())
        about = ["bank_id", "acct_id", "acct_type", "currency", "balance", "balance_date"]
        assert sorted(map(str, ofx.statements(records).select(*about).collect())) == sorted(map(str, whole.select(*about).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_gate(spark):
    rows = [("a.OFX", "<STMTTRN>", None), ("a.b.qfx", "<stmttrn>", None), ("a.ofx.txt", "<STMTTRN>", "extension"), (None, "<STMTTRN>", "extension"), ("a.ofx", " \r\n", "empty"), ("a.ofx", None, "empty"), ("a.ofx", "<OFX>", "no_transactions")]
    got = ofx.gate(spark.createDataFrame([r[:2] for r in rows], "file string, content string")).collect()
    assert [r["reason"] for r in got] == [r[2] for r in rows]


def test_feed_rows(spark):
    page = '{"total":3,"totalPages":1,"page":1,"results":[{"id":"a","accountId":"k","description":"","descriptionRaw":"iFood","amount":-10.5,"date":"2024-01-02T03:04:05Z","paymentData":{"payer":{"name":"P"}}},{"id":"b","accountId":"k","amount":3,"date":"2024-01-03T00:00:00Z"}]}'
    rows = spark.createDataFrame([(page,)], "body string").select(F.explode(F.from_json("body", feeds.page_schema(feeds.TRANSACTION))["results"]).alias("r")).select("r.*")
    assert [(r["external_id"], r["description"], r["amount"], r["category"]) for r in feeds.flat_transactions(rows).orderBy("external_id").collect()] == [("pluggy_a", "iFood", Decimal("-10.50"), "comida"), ("pluggy_b", "Sem descrição", Decimal("3.00"), "desconhecido")]
    assert [r["paymentData"]["payer"]["name"] if r["paymentData"] else None for r in rows.orderBy("id").collect()] == ["P", None]


def test_incomplete_feeds_wait(spark, tmp_path):
    def landed(feed, page, pages, *ids):
        return json.dumps({"feed": feed, "page": page, "totalPages": pages, "results": [{"id": i} for i in ids]})

    land = [landed("whole", 1, 2, "a"), landed("whole", 2, 2, "b"), landed("lost", 1, 3, "c"), landed("lost", 3, 3, "d"), landed("grew", 1, 1, "e"), landed("grew", 2, 4, "f"), landed("none", 1, 0), landed(None, 1, 1, "g"), json.dumps({"feed": "bare", "results": [{"id": "h"}]})]
    (tmp_path / "p.json").write_text("\n".join(land))
    rows, waiting = feeds.split_feeds(feeds.read_landed(spark, str(tmp_path), feeds.ACCOUNT))
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b", "g", "h"]
    assert sorted(map(tuple, waiting.collect())) == [("grew", 4, 2, 3), ("lost", 3, 1, 2)]
    assert sorted(r["id"] for r in feeds.first_pages(feeds.read_landed(spark, str(tmp_path), feeds.ACCOUNT)).collect()) == ["a", "c", "e", "g", "h"]


def test_faults(spark):
    rows = [("loja", 5.0, "Nubank", None, None, "2024-01-02T03:04:05Z", []), ("", -1.0, "Nubank", 91.0, 0.0, "2024-01-02T03:04:05-03:00", ["description", "amount", "latitude", "timestamp"]), (None, None, "", None, None, None, ["description", "amount", "bankName", "timestamp"])]
    df = spark.createDataFrame([r[:-1] for r in rows], "description string, amount double, bankName string, latitude double, longitude double, timestamp string")
    assert [r["failed"] for r in validate.checked(df, "notification").collect()] == [r[-1] for r in rows]


@pytest.mark.parametrize("by", ["amount", "date"])
@pytest.mark.parametrize("descending", [True, False])
def test_seeking_gives_the_pages_of_an_offset(spark, by, descending):
    """Ties, rows without a value, and pages that end in the middle of both."""
    rng = random.Random(3)
    rows = [(f"{i:03}", None if i % 9 == 0 else Decimal(rng.randrange(20)), None if i % 7 == 0 else dt.datetime(2024, 1, 1 + rng.randrange(9))) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, amount decimal(15,2), date timestamp_ntz")
    sort = search.ordered(df, by, descending).collect()
    for known in (None, search.cuts(df, by, rows=12)):
        last = None
        for n in range(0, 90, 11):
            got = search.after(df, last, by, descending, 11, known).collect()
            assert got == sort[n : n + 11]
            last = (got[-1][by], got[-1]["id"])
        assert search.after(df, last, by, descending, 11, known).count() == 0
    with pytest.raises(ValueError, match="collation"):
        search.after(df, None, "description")


def test_a_far_page_reads_what_an_early_one_reads(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7 % 40_000).cast("decimal(15,2)").alias("amount"))
    df.repartitionByRange(40, "amount", "id").sortWithinPartitions("amount", "id").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    known = search.cuts(table, "amount", rows=1_000)

    def read(last):
        page = search.after(table, last, "amount", known=known)
        assert len(page.collect()) == 8
        return scanned(page)[1]

    assert 0 < read((Decimal(39_000), "x")) < 3_000 > read((Decimal(2_000), "x"))


def test_statement_heads_are_read_in_steps(spark, sf):
    """What finds a balance's date stands once in the plan, and texts of one small file are read by several tasks."""
    from tidalbook.plans import queries as q

    df = q.QUERIES["ofx_parse"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("dtasof") < 20
    assert df.select("file", F.spark_partition_id().alias("p")).select("p").distinct().count() > 1


def test_lines_are_filtered_by_their_values(spark, tmp_path):
    """A filter on what a line lacks does not search the text once more."""
    (tmp_path / "a.ofx").write_text("<OFX><ACCTID>7</ACCTID><STMTTRN><DTPOSTED>20240101<TRNAMT>1<FITID>1</STMTTRN><STMTTRN><DTPOSTED>20240101<TRNAMT>1</STMTTRN></OFX>")
    df = ofx.lines(ofx.read_records(spark, str(tmp_path))).where(F.size("missing") == 0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "FITID" in x]
    assert [r["external_id"] for r in df.collect()] == ["ofx_7_1"]
