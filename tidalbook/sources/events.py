"""Device notifications, landed trip receipts, demo data and the health row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import with_defaults

NOTIFICATION = "title string, body string, date timestamp"


def notification_rows(events: DataFrame) -> DataFrame:
    """Purchases among notifications (``title``, ``body``, ``date``) as unsigned ledger input; works on streams too."""
    title, body = F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("body"), F.lit(""))
    # one row each, so that tokens are found once before amounts are read from them: in one expression they would be copied into each place
    parts = F.struct(title.alias("title"), body.alias("body"), text.money_token(body).alias("in_body"), text.money_token(title).alias("in_title"), F.col("date"))
    told = events.where(text.is_purchase(title, body)).select(F.inline(F.array(parts)))
    read = F.struct(text.parse_amount(F.col("in_body")).alias("in_body"), text.parse_amount(F.col("in_title")).alias("in_title"), text.detect_bank(F.col("title"), F.col("body")).alias("bank"), text.extract_merchant(F.col("body")).alias("description"), F.col("date"))
    rows = told.select(F.inline(F.array(read)))
    amount = F.abs(F.coalesce(F.nullif(F.col("in_body"), F.lit(0).cast("decimal(15,2)")), F.col("in_title")))
    return rows.select("description", amount.alias("amount"), "bank", "date").where(F.col("bank").isNotNull() & (F.col("amount") > 0))


def read_notifications(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(NOTIFICATION).json(path)


def health(spark: SparkSession, version: str = "1.0.0") -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.current_timestamp().alias("timestamp"), F.lit(version).alias("version"))


# The demo ledger's accounts (name, type, balance) and rows (account, description, amount, days ago, category, source, latitude, longitude).
DEMO_ACCOUNTS = (("Nubank Conta Corrente", "banco", "8450.00"), ("Nubank Cartão de Crédito", "banco", "4000.00"))
DEMO_ROWS = (
    (0, "Salário Empresa XYZ", "5200.00", 2, "salario", "pluggy", None, None),
    (0, "Freelance Design", "1200.00", 8, "salario", "pluggy", None, None),
    (0, "Dividendos Fundo Imobiliário", "180.50", 3, "investimento", "pluggy", None, None),
    (1, "iFood - Pizza ao Molho", "-52.90", 1, "comida", "notification", -23.5505, -46.6333),
    (1, "Mercado Livre - Hortifruti", "-89.40", 3, "comida", "pluggy", None, None),
    (1, "McDonald's - Shopping", "-43.70", 5, "comida", "notification", -23.5613, -46.6559),
    (1, "Padaria Pão Dourado", "-18.50", 7, "comida", "notification", None, None),
    (1, "iFood - Sushi Delivery", "-78.00", 12, "comida", "notification", -23.5480, -46.6388),
    (1, "Supermercado Extra", "-213.60", 15, "comida", "ofx", None, None),
    (1, "Restaurante Japonês Sakura", "-95.00", 18, "comida", "notification", -23.5545, -46.6448),
    (1, "Uber - Av. Paulista → Pinheiros", "-24.50", 1, "transporte", "uber", -23.5629, -46.6544),
    (1, "Uber - Centro → Vila Madalena", "-31.80", 4, "transporte", "uber", -23.5575, -46.6969),
    (1, "Uber - Moema → Berrini", "-19.90", 9, "transporte", "uber", -23.5989, -46.6862),
    (1, "Shell - Combustível", "-180.00", 10, "transporte", "ofx", None, None),
    (1, "Estacionamento Shopping Iguatemi", "-22.00", 14, "transporte", "notification", None, None),
    (1, "Netflix Premium", "-55.90", 5, "assinaturas", "pluggy", None, None),
    (1, "Spotify Família", "-34.90", 5, "assinaturas", "pluggy", None, None),
    (1, "Adobe Creative Cloud", "-259.00", 6, "assinaturas", "pluggy", None, None),
    (1, "GitHub Copilot", "-55.90", 7, "assinaturas", "pluggy", None, None),
    (1, "ChatGPT Plus", "-103.00", 8, "assinaturas", "pluggy", None, None),
    (1, "Ingresso Cinema Kinoplex", "-42.00", 11, "lazer", "notification", None, None),
    (1, "Steam - Elden Ring DLC", "-79.99", 13, "lazer", "notification", None, None),
    (1, "Bar do Zé - Happy Hour", "-68.00", 16, "lazer", "notification", None, None),
    (1, "Farmácia São João", "-87.50", 6, "saude", "notification", None, None),
    (1, "Consulta Médica - Dr. Silva", "-280.00", 20, "saude", "ofx", None, None),
    (1, "Academia Smart Fit", "-109.90", 5, "saude", "pluggy", None, None),
    (0, "Aluguel Apartamento", "-2200.00", 1, "moradia", "ofx", None, None),
    (0, "Conta de Luz ENEL", "-187.30", 8, "moradia", "ofx", None, None),
    (0, "Internet Vivo Fibra", "-99.90", 8, "moradia", "pluggy", None, None),
    (0, "Condomínio", "-650.00", 5, "moradia", "ofx", None, None),
    (1, "Udemy - Curso TypeScript Avançado", "-69.90", 22, "educacao", "notification", None, None),
    (1, "Rocketseat Pro", "-249.90", 25, "educacao", "pluggy", None, None),
    (0, "Aporte CDB Nubank 110% CDI", "-500.00", 4, "investimento", "pluggy", None, None),
    (0, "Tesouro Direto IPCA+", "-300.00", 4, "investimento", "pluggy", None, None),
)


def demo(spark: SparkSession, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The demo ledger before ``as_of``: accounts and transactions, with ids and times of day that are the same on every run."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    accounts = [(f"acc-{i}", *a, as_of, as_of) for i, a in enumerate(DEMO_ACCOUNTS)]
    rows = [
        (f"demo-{i}", f"acc-{r[0]}", r[1], r[2], day - dt.timedelta(days=r[3]) + dt.timedelta(hours=8 + i % 14, minutes=7 * i % 60), *r[4:], as_of, as_of)
        for i, r in enumerate(DEMO_ROWS)
    ]
    a = spark.createDataFrame(accounts, "id string, name string, type string, balance string, created_at timestamp, updated_at timestamp")
    t = spark.createDataFrame(rows, "id string, account_id string, description string, amount string, date timestamp, category string, source string, latitude double, longitude double, created_at timestamp, updated_at timestamp")
    return with_defaults(a, "accounts"), with_defaults(t, "transactions")
