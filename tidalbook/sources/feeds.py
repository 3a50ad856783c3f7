"""Landed pages of the open-banking feed, and other JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

ACCOUNT = (
    "id string, type string, subtype string, number string, name string, balance double, currencyCode string, itemId string, "
    "bankData struct<transferNumber:string,closingBalance:double>, "
    "creditData struct<level:string,brand:string,balanceCloseDate:string,balanceDueDate:string,availableCreditLimit:double,creditLimit:double,minimumPayment:double>"
)
_PARTY = "struct<name:string,documentNumber:struct<type:string,value:string>,accountNumber:string,branchNumber:string,routingNumber:string>"
TRANSACTION = (
    "id string, accountId string, description string, descriptionRaw string, amount double, date string, category string, type string, currencyCode string, "
    "creditCardMetadata struct<installmentNumber:int,totalInstallments:int,totalAmount:double>, "
    f"paymentData struct<payer:{_PARTY},receiver:{_PARTY},paymentMethod:string,reason:string>"
)
ITEM = (
    "id string, connector struct<id:int,name:string,primaryColor:string,institutionUrl:string,type:string>, status string, executionStatus string, "
    "createdAt string, updatedAt string, lastUpdatedAt string, error struct<code:string,message:string>"
)
#: Small request bodies.
PAYLOADS = {
    "notification": "description string, amount double, bankName string, latitude double, longitude double, timestamp string",
    "trip": "valor double, data_hora string, endereco_partida string, endereco_destino string, nome_motorista string, duracao_segundos int",
    "sync": "itemId string",
    "webhook": "event string, itemId string",
    "event": "title string, body string, date string",
}


def page_schema(results: str) -> T.StructType:
    return T.StructType.fromDDL("total int, totalPages int, page int").add("results", T.ArrayType(T.StructType.fromDDL(results)))


def read_pages(spark: SparkSession, path: str, results: str, first_only: bool = False) -> DataFrame:
    """Rows of all landed pages (the first one only for accounts), with an explicit schema."""
    pages = spark.read.schema(page_schema(results)).option("multiLine", True).json(path)
    if first_only:
        pages = pages.where(F.coalesce("page", F.lit(1)) == 1)
    return pages.select(F.explode("results").alias("r")).select("r.*")


def read_landed(spark: SparkSession, path: str, results: str) -> DataFrame:
    """Landed pages, one JSON object a line, each with the ``feed`` it was asked for (an account, an item): ``feed``, ``page``, ``totalPages``, ``results``."""
    kind = T.StructType([T.StructField("feed", T.StringType()), *page_schema(results).fields])
    return spark.read.schema(kind).json(path).select("feed", F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("totalPages", F.lit(1)).alias("totalPages"), "results")


def missing_pages(pages: DataFrame) -> DataFrame:
    """``feed``, ``expected``, ``missing``, ``first_missing`` of feeds that lack pages; a feed's number of pages is the largest that any of its pages tells.

    Pages without a feed's name are one feed.
    """
    told = pages.groupBy("feed").agg(F.max("totalPages").alias("expected")).where("expected > 0")
    every = told.select("feed", "expected", F.explode(F.sequence(F.lit(1), "expected")).alias("page"))
    there = pages.select(F.col("feed").alias("f"), F.col("page").alias("p"))
    lacking = every.join(there, F.col("feed").eqNullSafe(F.col("f")) & (F.col("page") == F.col("p")), "left_anti")
    return lacking.groupBy("feed", "expected").agg(F.count("*").alias("missing"), F.min("page").alias("first_missing"))


def split_feeds(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of feeds whose pages have all landed, and the incomplete feeds, which wait.

    A page that landed twice gives its rows twice; their ids tell them apart from others.
    """
    waiting = missing_pages(pages)
    whole = pages.join(waiting.select(F.col("feed").alias("f")), F.col("feed").eqNullSafe(F.col("f")), "left_anti")
    return whole.select("feed", F.explode("results").alias("r")).select("feed", "r.*"), waiting


def first_pages(pages: DataFrame) -> DataFrame:
    """Rows of the first page of each feed: all that is taken of a list of accounts."""
    return pages.where("page = 1").select("feed", F.explode("results").alias("r")).select("feed", "r.*")


def flat_transactions(rows: DataFrame) -> DataFrame:
    """Feed rows as ledger rows."""
    described = text.first_filled(F.col("description"), F.col("descriptionRaw"), F.lit("Sem descrição"))
    return rows.select(
        text.external_id_feed(F.col("id")).alias("external_id"), F.col("accountId").alias("pluggy_account_id"), described.alias("description"),
        F.col("amount").try_cast("decimal(15,2)").alias("amount"), F.try_to_timestamp("date").alias("date"), text.categorize(described).alias("category"), F.lit("pluggy").alias("source"),
    )


def flat_accounts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("pluggy_account_id"), F.col("itemId").alias("pluggy_item_id"), text.first_filled(F.col("name"), F.lit("Conta")).alias("name"), F.col("balance").cast("decimal(15,2)").alias("balance"))


def flat_items(rows: DataFrame) -> DataFrame:
    """Connections to banks, one row each; ``failed`` tells those whose last run ended in an error."""
    moment = lambda c: F.to_timestamp(c).alias(c)
    return rows.select(
        F.col("id").alias("pluggy_item_id"), F.col("connector.id").alias("connector_id"), F.col("connector.name").alias("connector"), "status", "executionStatus",
        moment("createdAt"), moment("updatedAt"), moment("lastUpdatedAt"), F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"), F.col("error").isNotNull().alias("failed"),
    )


def split_rows(rows: DataFrame, needed: tuple[str, ...] = ("external_id", "amount", "date")) -> tuple[DataFrame, DataFrame]:
    """Ledger rows that can be stored, and the others with the names of what is missing, so that a bad row does not stop its batch."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in needed)))
    marked = rows.withColumn("missing", lacking)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def parse_payload(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The fields of a JSON text; a text that does not parse gives nulls, not an error."""
    return df.withColumn("__p", F.from_json(column, PAYLOADS[kind])).select(*df.columns, "__p.*")
