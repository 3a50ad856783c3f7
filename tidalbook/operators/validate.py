"""Row checks: valid rows, and rejected rows with the names of the failed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema

ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _c(name: str) -> Column:
    return F.col(name)


def _optional(name: str, ok: Column) -> Column:
    return _c(name).isNull() | ok


def rules(kind: str) -> dict[str, Column]:
    """Field -> condition; a null condition counts as failed.  Fixed values: the fields' names, lengths and bounds."""
    lat, lng = _optional("latitude", _c("latitude").between(-90, 90)), _optional("longitude", _c("longitude").between(-180, 180))
    return {
        "transaction": lambda: {
            "account_id": _c("account_id").rlike(UUID), "description": F.length("description").between(1, 500), "amount": _c("amount").cast("string").rlike(r"^-?\d+(\.\d{1,2})?$"),
            "date": _c("date").rlike(ISO_UTC), "category": _optional("category", schema.in_domain(_c("category"), schema.CATEGORIES)),
            "source": _optional("source", schema.in_domain(_c("source"), schema.SOURCES)), "external_id": _optional("external_id", F.length("external_id") <= 255), "latitude": lat, "longitude": lng,
        },
        "notification": lambda: {"description": F.length("description") >= 1, "amount": _c("amount") > 0, "bankName": F.length("bankName") >= 1, "latitude": lat, "longitude": lng, "timestamp": _c("timestamp").rlike(ISO_UTC)},
        "sync": lambda: {"itemId": F.length("itemId") >= 1},
        "trip": lambda: {
            "valor": _c("valor") > 0, "data_hora": _c("data_hora").rlike(ISO_UTC), "endereco_partida": F.length("endereco_partida") >= 1, "endereco_destino": F.length("endereco_destino") >= 1,
            "duracao_segundos": _optional("duracao_segundos", _c("duracao_segundos") > 0),
        },
        "free_trip": lambda: rules("trip") | {"valor": _c("valor") >= 0},
        "nearby": lambda: {"latitude": _c("latitude").between(-90, 90), "longitude": _c("longitude").between(-180, 180), "radiusMeters": _optional("radiusMeters", (_c("radiusMeters") > 0) & (_c("radiusMeters") <= 50_000))},
        "ofx": lambda: {"account_id": _c("account_id").rlike(UUID), "content": F.length("content") >= 1},
    }[kind]()


def checked(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with ``failed``: the names of the fields that break a rule, in the rules' order."""
    bad = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules(kind).items()]
    return df.withColumn("failed", F.array_compact(F.array(*bad)))


def split(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    all_rows = checked(df, kind)
    return all_rows.where(F.size("failed") == 0).drop("failed"), all_rows.where(F.size("failed") > 0)
