"""The generic order and event tables seen as a ledger, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import UNKNOWN

#: Descriptions that reach every category, with accents, capitals, word ends and names that several rules touch; and what each must give.
DESCRIBED = {
    "iFood Pedido 31": "comida", "RESTAURANTE SABOR": "comida", "Uber Eats": "comida", "Padaria Central": "comida", "CAFÉ DO PORTO": "comida", "Mercado Livre Compra": "comida",
    "Uber Trip": "transporte", "Posto Shell BR": "transporte", "99 Taxi Corrida": "transporte", "Metrô SP": "transporte", "Imposto Municipal": "transporte",
    "Netflix.com": "assinaturas", "SPOTIFY AB": "assinaturas", "Max": "assinaturas", "Maximiliano Lima": UNKNOWN, "Cinema Roxy": "lazer", "Bar do Zeca": "lazer",
    "Barra Funda": UNKNOWN, "Livraria Cultura": "lazer", "Steam Purchase": "lazer", "Drogasil 221": "saude", "Farmácia Popular": "saude", "Academia Smart Fit": "saude",
    "Escola Infantil": "educacao", "Curso Alura": "educacao", "Aluguel Junho": "moradia", "Condomínio Sol": "moradia", "Água e Esgoto": "moradia", "Enel SP": "moradia",
    "Salário Mensal": "salario", "Pró-Labore": "salario", "Férias": "salario", "Tesouro Selic": "investimento", "CDB Banco": "investimento", "Dividendo PETR": "investimento",
    "PIX Joana": "transferencia", "TED enviada": "transferencia", "Boleto 123": "transferencia", "Loja Sem Nome": UNKNOWN, "Presente": UNKNOWN,
}
VOCABULARY = tuple(DESCRIBED)
SOURCES = ("notification", "pluggy", "ofx", "manual", "uber")


def _nth(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def _shaped(df: DataFrame, key: str, account: str, amount: Column, date: str, external: Column, lat: Column, lng: Column) -> DataFrame:
    described = _nth(VOCABULARY, F.col(key))
    return df.select(
        F.col(key).cast("string").alias("id"), F.col(account).cast("string").alias("account_id"), described.alias("description"), amount.cast("decimal(15,2)").alias("amount"),
        F.col(date).cast("timestamp_ntz").alias("date"), text.categorize(described).alias("category"), _nth(SOURCES, F.col(key)).alias("source"), external.alias("external_id"),
        lat.alias("latitude"), lng.alias("longitude"),
    )


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    amount = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    none = F.lit(None).cast("double")
    return _shaped(df, "o_orderkey", "o_custkey", amount, "o_orderdate", text.external_id_feed(F.col("o_orderkey").cast("string")), none, none)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    amount = F.when(F.col("event_type") == "signup", F.col("value")).otherwise(-F.col("value"))
    at = lambda base, by: F.when(k % 3 != 0, F.lit(base) + ((k * by) % 2000 - 1000) / F.lit(10000.0))
    external = text.external_id_ofx(F.col("user_id").cast("string"), k.cast("string"))
    return _shaped(df, "event_id", "user_id", amount, "ts", external, at(-23.55, 7919), at(-46.63, 104729))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), "event_type")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "carteira").otherwise("banco")
    return df.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), kind.alias("type"), F.col("c_acctbal").cast("decimal(15,2)").alias("balance"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips made from purchases, with time and price moved by amounts that depend on the id."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    moved = F.expr("cast(ts as timestamp_ntz) + make_dt_interval(0, 0, cast((event_id * 37) % 300 - 150 as int))")
    price = (F.col("value").cast("decimal(15,2)") + ((F.col("event_id") % 7 - 3) * F.lit(1).cast("decimal(3,2)")).cast("decimal(15,2)")).cast("decimal(15,2)")
    return df.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.abs(price).alias("amount"), moved.alias("date"), F.concat(F.lit("Rua "), F.col("user_id").cast("string")).alias("origin"), F.col("event_type").alias("destination"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql(key: str, account: str, amount: str, date: str, external: str, lat: str, lng: str, source: str) -> str:
    return f"""select * from (
  select cast({key} as varchar) as id, cast({account} as varchar) as account_id, list_extract({sql_list(VOCABULARY)}, cast({key} % {len(VOCABULARY)} as int) + 1) as description,
    list_extract({sql_list(DESCRIBED.values())}, cast({key} % {len(VOCABULARY)} as int) + 1) as category,
    cast({amount} as decimal(15,2)) as amount, {date} as date, list_extract({sql_list(SOURCES)}, cast({key} % {len(SOURCES)} as int) + 1) as source,
    {external} as external_id, {lat} as latitude, {lng} as longitude from {source})"""


LO = _sql("o_orderkey", "o_custkey", "case when o_orderstatus = 'F' then o_totalprice else -o_totalprice end", "o_orderdate", "'pluggy_' || o_orderkey", "cast(null as double)", "cast(null as double)", "orders")
LE = _sql(
    "event_id", "user_id", "case when event_type = 'signup' then value else -value end", "ts", "'ofx_' || user_id || '_' || event_id",
    "case when event_id % 3 <> 0 then cast(-23.55 as double) + ((event_id * 7919) % 2000 - 1000) / cast(10000 as double) end",
    "case when event_id % 3 <> 0 then cast(-46.63 as double) + ((event_id * 104729) % 2000 - 1000) / cast(10000 as double) end", "events",
)
AC = "select cast(c_custkey as varchar) as id, c_name as name, case when c_mktsegment = 'HOUSEHOLD' then 'carteira' else 'banco' end as type, cast(c_acctbal as decimal(15,2)) as balance from customer"
TR = """select 't' || event_id as id, abs(cast(cast(value as decimal(15,2)) + (event_id % 7 - 3) as decimal(15,2))) as amount,
  ts + to_minutes(cast((event_id * 37) % 300 - 150 as int)) as date, 'Rua ' || user_id as origin, event_type as destination from events where event_type = 'purchase'"""
