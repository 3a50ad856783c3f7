"""Registered queries of the text functions and sources: their inputs are texts that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import validate
from ..session import scratch
from ..sources import events, feeds, ofx
from . import adapter as a
from . import examples, search
from .queries import ISO, NOW, doubles, le, num, query, sql_values

_K = "cast(l.id as bigint)"


def k(n: int):
    return F.col("id").cast("long") % n


def chosen(n: int, *values):
    """One of ``n`` values, by the row's id."""
    return F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (k(n) + 1).cast("int"))


def made(df, *columns):
    """Rows of the texts, made before they are read: without this, Spark would write each text's expression into every place that reads it."""
    return df.select(F.inline(F.array(F.struct(*columns))))


# --- money


@query("parse_amount", f"select l.id, cast(case when {_K} % 4 < 3 then balance end as double) as amount from ({a.AC}) l")
def _(spark, d):
    """Balances as banks and people write them; every fourth is more than a number."""
    plain = F.col("balance").cast("string")
    written = chosen(4, text.format_brl(F.col("balance")), plain, F.translate(plain, ".", ","), F.concat(F.lit("saldo "), plain))
    return made(a.accounts(spark, d), "id", written.alias("text")).select("id", text.parse_amount(F.col("text")).cast("double").alias("amount"))


@query("extract_amount", le(f"select l.id, cast(case when {_K} % 3 < 2 then abs(amount) end as double) as amount from l"))
def _(spark, d):
    brl = text.format_brl(F.abs("amount"))
    said = chosen(3, F.concat(F.lit("Compra aprovada de "), brl, F.lit(" em "), "description"), F.concat(F.lit("Pagamento "), F.regexp_replace(brl, "^[^0-9]*", ""), F.lit(" no valor")), F.concat(F.lit("sem valor em "), "category"))
    return made(a.ledger_events(spark, d), "id", said.alias("text")).select("id", text.extract_amount(F.col("text")).cast("double").alias("amount"))


# --- notifications

_TITLES = ("Nubank", "Banco Itaú informa", "Loja", "Cartão C6", "Aviso do Inter")
_BANKS = ("Nubank", "Itaú", None, "C6 Bank", "Inter")


def _told(spark, d):
    """Titles of five senders; bodies of purchases, advertisements and transfers."""
    paid = F.concat(F.lit("Compra de "), text.format_brl(F.abs("amount")), F.lit(" em "), "description", F.lit(" no valor aprovado"))
    body = chosen(3, paid, F.concat(F.lit("Oferta: "), "category"), F.concat(F.lit("PIX ENVIADO, "), "category"))
    return made(a.ledger_events(spark, d), "id", chosen(5, *_TITLES).alias("title"), body.alias("body"))


@query("detect_bank", le(f"select l.id, case {_K} % 5 " + " ".join(f"when {i} then '{b}'" for i, b in enumerate(_BANKS) if b) + " end as bank from l"))
def _(spark, d):
    return _told(spark, d).select("id", text.detect_bank(F.col("title"), F.col("body")).alias("bank"))


@query("purchase_filter", le(f"select l.id, {_K} % 3 <> 1 or category = 'transferencia' as purchase from l"))
def _(spark, d):
    return _told(spark, d).select("id", text.is_purchase(F.col("title"), F.col("body")).alias("purchase"))


@query("extract_merchant", le(f"select l.id, case {_K} % 3 when 0 then lower(description) when 1 then 'Oferta: ' || category else 'PIX ENVIADO, ' || category end as merchant from l"))
def _(spark, d):
    return _told(spark, d).select("id", text.extract_merchant(F.col("body")).alias("merchant"))


# A fault of a notification, by the row's id: field and what it becomes.
_FAULTS = (("description", ""), ("amount", -1.0), ("bankName", ""), ("latitude", 91.0), ("timestamp", "2024-01-02T03:04:05-03:00"))


@query("validate_notifications", le(f"select l.id, case {_K} % 7 " + " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(_FAULTS)) + " else '' end as failed from l"))
def _(spark, d):
    """The events as notification bodies; of seven rows, five have one fault each."""
    rows = a.ledger_events(spark, d)
    fields = {"description": F.col("description"), "amount": F.abs("amount").cast("double") + 1, "bankName": F.lit("Nubank"), "latitude": F.col("latitude"), "longitude": F.col("longitude"), "timestamp": dates.iso(F.col("date"))}
    broken = fields | {c: F.when(k(7) == i, F.lit(v)).otherwise(fields[c]) for i, (c, v) in enumerate(_FAULTS)}
    rows = rows.select("id", *(c.alias(n) for n, c in broken.items()))
    return validate.checked(rows, "notification").select("id", F.array_join("failed", ",").alias("failed"))


# --- classification

_TEXTS, _NAMED = list(examples.EXAMPLES), list(examples.EXAMPLES.values())


@query("classify_examples", le(f"select list_extract({a.sql_list(_TEXTS)}, cast({_K} % {len(_TEXTS)} as int) + 1) as description, list_extract({a.sql_list(_NAMED)}, cast({_K} % {len(_TEXTS)} as int) + 1) as category, count(*) as n from l group by all"))
def _(spark, d):
    """Every event with one of the descriptions that only one pattern explains."""
    described = F.element_at(F.array(*map(F.lit, _TEXTS)), (k(len(_TEXTS)) + 1).cast("int"))
    return a.ledger_events(spark, d).groupBy(described.alias("description")).agg(F.count("*").alias("n")).withColumn("category", text.categorize(F.col("description")))


# --- statement texts


@query("tag_value", le(f"select l.id, case when {_K} % 3 < 2 then description else '' end as value from l"))
def _(spark, d):
    tagged = chosen(3, F.concat(F.lit("<NAME> "), "description", F.lit(" </NAME>")), F.concat(F.lit("<name>"), "description", F.lit("\n<MEMO>x")), F.concat(F.lit("<MEMO>"), "description"))
    return made(a.ledger_events(spark, d), "id", tagged.alias("text")).select("id", text.tag_value(F.col("text"), "NAME").alias("value"))


@query("tag_blocks", le(f"select l.id, case when {_K} % 3 < 2 then l.id || ';' || description else '' end as blocks from l"))
def _(spark, d):
    tagged = chosen(3, F.concat(F.lit("<T>"), "id", F.lit("</T>x<t>"), "description", F.lit("</t>")), F.concat(F.lit("h<T>"), "id", F.lit("<T>"), "description"), F.col("description"))
    return made(a.ledger_events(spark, d), "id", tagged.alias("text")).select("id", F.array_join(text.tag_blocks(F.col("text"), "T"), ";").alias("blocks"))


_MOMENTS = f"case {_K} % 5 when 0 then strftime(l.date, '%Y-%m-%dT%H:%M:%S') || '-03:00' when 1 then strftime(l.date, '%Y-%m-%dT00:00:00Z') when 2 then strftime(l.date, '%Y-%m-%dT%H:%M:%SZ') when 3 then strftime(l.date, '%Y-%m-%dT%H:00:00') || '+05:00' else '2024-01-31T00:00:00Z' end"


@query("parse_ofx_date", le(f"select l.id, {_MOMENTS} as date from l"))
def _(spark, d):
    """Moments in all forms that statements have; what does not begin with a day becomes the time of import."""
    at = lambda form, zone="": F.concat(F.date_format("date", form), F.lit(zone))
    raw = chosen(5, at("yyyyMMddHHmmss", "[-03:BRT]"), at("yyyyMMdd"), at("yyyyMMddHHmmss.SSS"), at("yyyyMMddHH", "[5:X]"), at("yyyy"))
    return made(a.ledger_events(spark, d), "id", raw.alias("text")).select("id", dates.parse_ofx_date(F.col("text"), F.lit("2024-01-31T00:00:00Z")).alias("date"))


_HEADS = f"""select l.id || '.qfx' as file, '341' as bank_id, l.id as acct_id, case when type = 'carteira' then 'SAVINGS' else 'CHECKING' end as acct_type, case when {_K} % 2 = 0 then 'USD' else 'BRL' end as currency,
  cast(balance as double) as balance, '2024-01-31T00:00:00Z' as balance_date from ({a.AC}) l"""


@query("ofx_parse", _HEADS)
def _(spark, d):
    """Every account's statement head and balance, read back from its text."""
    kind, money = F.when(F.col("type") == "carteira", "<ACCTTYPE>SAVINGS\r\n").otherwise(""), F.when(k(2) == 0, "<CURDEF>USD</CURDEF>").otherwise("")
    tag = F.when(k(3) == 0, "LEDGERBAL").otherwise("AVAILBAL")
    content = F.concat(F.lit("<OFX><BANKID>341</BANKID><ACCTID>"), "id", F.lit("\r\n"), kind, money, F.lit("<"), tag, F.lit("><BALAMT>"), F.col("balance").cast("string"), F.lit("\r\n<DTASOF>20240131\r\n</"), tag, F.lit("></OFX>"))
    # a small table holds many rows, which a scan would give to few tasks
    spread = a.accounts(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    files = made(spread, F.concat("id", F.lit(".qfx")).alias("file"), content.alias("content"))
    return doubles(ofx.parse(files).select("file", "bank_id", "acct_id", "acct_type", "currency", "balance", "balance_date"), "balance")


@query("ofx_gate", f"select reason, count(*) as n from (select case {_K} % 5 when 3 then 'extension' when 4 then 'empty' when 2 then 'no_transactions' end as reason from ({a.AC}) l) group by reason")
def _(spark, d):
    """Every account uploads a file: statements, one without lines, one of another kind, one blank."""
    name = F.concat("id", chosen(5, ".ofx", ".QFX", ".Ofx", ".ofx.txt", ".qfx"))
    content = chosen(5, "<STMTTRN><TRNAMT>1", "x<stmttrn>", "<OFX></OFX>", "<STMTTRN>", " \r\n")
    return ofx.gate(a.accounts(spark, d).select(name.alias("file"), content.alias("content"))).groupBy("reason").agg(F.count("*").alias("n"))


_LINES = f"select 'ofx_' || e.event_type || '_' || l.id as external_id, l.description, cast(l.amount as double) as amount, strftime(l.date, '%Y-%m-%dT%H:%M:%S') || '-03:00' as date, 77.5::double as balance from l join e using (id) where {_K} % 5 > 0"


@query("ofx_records", le(_LINES))
def _(spark, d):
    """All events of a type as one large statement file, read by the marks of its lines; every fifth line has no id and is rejected."""
    rows = a.ledger_events(spark, d).join(a.event_types(spark, d), "id").withColumnRenamed("event_type", "acct")
    fit = F.when(k(5) > 0, F.concat(F.lit("<FITID>"), "id")).otherwise("")
    line = F.concat(F.lit("<STMTTRN><DTPOSTED>"), F.date_format("date", "yyyyMMddHHmmss"), F.lit("[-03:BRT]<TRNAMT>"), F.col("amount").cast("string"), fit, F.lit("<NAME>"), "description", F.lit("</STMTTRN>"))
    body = rows.select("acct", F.lit(1).alias("place"), line.alias("value"))
    accts = rows.select("acct").distinct()
    head = accts.select("acct", F.lit(0).alias("place"), F.concat(F.lit("<OFX><ACCTID>"), "acct", F.lit("</ACCTID><BANKTRANLIST>")).alias("value"))
    tail = accts.select("acct", F.lit(2).alias("place"), F.lit("</BANKTRANLIST><LEDGERBAL><BALAMT>77.50<DTASOF>20240131</LEDGERBAL></OFX>").alias("value"))
    path = scratch(spark, "statements")
    head.unionByName(body).unionByName(tail).repartition("acct").sortWithinPartitions("acct", "place").select("acct", "value").write.partitionBy("acct").text(path)
    records = ofx.read_records(spark, path, "*")
    good = ofx.lines(records).where(F.size("missing") == 0)
    return good.join(ofx.statements(records).select("file", "balance"), "file").select("external_id", "description", num("amount"), "date", num("balance"))


# --- feeds


@query("json_flatten", le(f"select 'pluggy_' || l.id as external_id, l.account_id as account, case when {_K} % 3 = 0 then 'Sem descrição' else l.description end as description, cast(l.amount as double) as amount, case when {_K} % 3 = 0 then 'desconhecido' else l.category end as category, case when {_K} % 2 = 0 then ac.name end as payer from l left join ac on ac.id = l.account_id"))
def _(spark, d):
    """Each event as a feed's nested row in JSON, read back flat; a third of them without a description."""
    rows = search.with_account(a.ledger_events(spark, d), a.accounts(spark, d))
    payer = F.when(k(2) == 0, F.struct(F.struct(F.col("account_name").alias("name")).alias("payer")))
    item = F.struct("id", F.col("account_id").alias("accountId"), F.lit("").alias("description"), F.when(k(3) > 0, F.col("description")).alias("descriptionRaw"), F.col("amount").cast("double").alias("amount"), dates.iso(F.col("date")).alias("date"), payer.alias("paymentData"))
    read = made(rows, F.to_json(item).alias("body")).select(F.from_json("body", feeds.TRANSACTION).alias("r")).select("r.*")
    flat = feeds.flat_transactions(read)
    names = read.select(text.external_id_feed(F.col("id")).alias("external_id"), F.col("paymentData.payer.name").alias("payer"))
    return flat.join(names, "external_id").select("external_id", F.col("pluggy_account_id").alias("account"), "description", num("amount"), "category", "payer")


@query("feed_items", f"select l.id, c_nationkey as connector_id, n_name as connector, case when {_K} % 5 = 0 then 'LOGIN' end as error_code, {_K} % 5 = 0 as failed from ({a.AC}) l join customer on c_custkey = {_K} join nation on n_nationkey = c_nationkey")
def _(spark, d):
    """Each account's connection to a bank of its nation as JSON, every fifth with an error."""
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("id", F.col("c_custkey").cast("string"))
    error = F.when(k(5) == 0, F.struct(F.lit("LOGIN").alias("code"), F.lit("m").alias("message")))
    item = F.struct("id", F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name")).alias("connector"), F.lit("UPDATED").alias("status"), error.alias("error"))
    read = made(c, F.to_json(item).alias("body")).select(F.from_json("body", feeds.ITEM).alias("r")).select("r.*")
    return feeds.flat_items(read).select(F.col("pluggy_item_id").alias("id"), F.col("connector_id").cast("long").alias("connector_id"), "connector", "error_code", "failed")


def _landed(rows, per_page: int, path: str, feed: str, item, order: str = "id"):
    """``rows`` in pages of ``per_page``, as files of one JSON object a line; a feed's pages are numbered from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy(feed).orderBy(order)
    numbered = rows.withColumns({"page": F.ceil(F.row_number().over(w) / per_page).cast("int"), "totalPages": F.ceil(F.count("*").over(Window.partitionBy(feed)) / per_page).cast("int")})
    return numbered.groupBy(F.col(feed).alias("feed"), "page", "totalPages").agg(F.collect_list(item).alias("results"))


_PAGED = "p as (select l.*, ceil(row_number() over (partition by account_id order by l.id) / 4.0) as page, ceil(count(*) over (partition by account_id) / 4.0) as pages from l), lost as (select distinct account_id from p where cast(account_id as bigint) % 6 = 0 and page = 2)"


def _feeds(spark, d):
    """Every account's events in pages of four, landed as files; of every sixth account the second page is lost."""
    rows, path = a.ledger_events(spark, d), scratch(spark, "feeds")
    item = F.struct("id", F.col("account_id").alias("accountId"), "description", F.col("amount").cast("double").alias("amount"), dates.iso(F.col("date")).alias("date"))
    _landed(rows, 4, path, "account_id", item).where((F.col("feed").cast("long") % 6 > 0) | (F.col("page") != 2)).write.json(path)
    return feeds.split_feeds(feeds.read_landed(spark, path, feeds.TRANSACTION))


@query("feed_complete", le("select 1").rsplit(" select 1", 1)[0] + f", {_PAGED} select 'pluggy_' || id as external_id, cast(amount as double) as amount from p where account_id not in (select account_id from lost)")
def _(spark, d):
    """Rows of the feeds that have landed whole."""
    return feeds.flat_transactions(_feeds(spark, d)[0]).select("external_id", num("amount"))


@query("feed_incomplete", le("select 1").rsplit(" select 1", 1)[0] + f", {_PAGED} select account_id as feed, cast(max(pages) as integer) as expected, 1::bigint as missing, 2 as first_missing from p where account_id in (select account_id from lost) group by account_id")
def _(spark, d):
    return _feeds(spark, d)[1]


@query("feed_accounts", "select c_custkey::varchar as id, c_nationkey::varchar as item, c_name as name, cast(cast(c_acctbal as decimal(15,2)) as double) as balance, c_mktsegment as transfer, case when c_mktsegment = 'HOUSEHOLD' then 1000.0::double end as credit from (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer) where n <= 500")
def _(spark, d):
    """The accounts of each nation's item in landed pages of 500, of which the first is taken, with their nested bank and credit data."""
    c, path = spark.read.parquet(f"{d}/customer.parquet").withColumn("item", F.col("c_nationkey").cast("string")), scratch(spark, "accounts")
    credit = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.struct(F.lit(1000.0).alias("creditLimit")))
    item = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), F.col("item").alias("itemId"), F.struct(F.col("c_mktsegment").alias("transferNumber")).alias("bankData"), credit.alias("creditData"))
    _landed(c, 500, path, "item", item, "c_custkey").write.json(path)
    rows = feeds.first_pages(feeds.read_landed(spark, path, feeds.ACCOUNT))
    nested = rows.select("id", F.col("bankData.transferNumber").alias("transfer"), F.col("creditData.creditLimit").alias("credit"))
    flat = feeds.flat_accounts(rows).withColumnRenamed("pluggy_account_id", "id")
    return flat.join(nested, "id").select("id", F.col("pluggy_item_id").alias("item"), "name", num("balance"), "transfer", "credit")


# --- pages by seeking


@query("browse_seek", le("select id, cast(amount as double) as amount from l order by l.amount desc, id limit 24"))
def _(spark, d):
    """Three pages of the ledger by amount, each read from where the last one ended, from a copy in the order of amounts."""
    rows, path = a.ledger_events(spark, d), scratch(spark, "by_amount")
    rows.repartitionByRange("amount", "id").sortWithinPartitions("amount", "id").write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    known, last, pages = search.cuts(stored, "amount"), None, []
    for _ in range(3):
        page = search.after(stored, last, "amount", known=known)
        pages.append(page.select("id", num("amount")))
        end = page.collect()
        last = (end[-1]["amount"], end[-1]["id"]) if end else last
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


# --- demo rows and health beside a ledger

_DEMO = [("salario", 2, 6400.0), ("investimento", 3, -619.5), ("comida", 7, -591.1), ("transporte", 5, -278.2), ("assinaturas", 5, -508.7), ("lazer", 3, -189.99), ("saude", 3, -477.4), ("moradia", 4, -3137.2), ("educacao", 2, -319.8)]


@query("demo_totals", le(f"select category, cast(sum(n) as bigint) as n, round(cast(sum(total) as double), 2) as total from (select category, count(*) as n, sum(amount) as total from l group by category union all select category, n, cast(total as decimal(15,2)) from {sql_values(_DEMO, 'category, n, total')}) group by category"))
def _(spark, d):
    """A ledger that the demo rows are added to."""
    cols = ["category", "amount"]
    both = a.ledger_events(spark, d).select(cols).unionByName(events.demo(spark, NOW)[1].select(cols))
    return both.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("amount").cast("double"), 2).alias("total"))


@query("health", le("select 'ok' as status, '1.0.0' as version, count(*) as transactions from l"))
def _(spark, d):
    """The health row, and that the ledger answers."""
    return events.health(spark).select("status", "version").join(F.broadcast(a.ledger_events(spark, d).agg(F.count("*").alias("transactions"))))
