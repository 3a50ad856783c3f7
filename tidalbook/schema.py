"""Tables of the ledger: types, domains and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
UNKNOWN = "desconhecido"

# The domains of the enumerated columns.
ACCOUNT_TYPES = ("banco", "carteira")
CATEGORIES = ("comida", "transporte", "assinaturas", "lazer", "saude", "educacao", "moradia", "salario", "investimento", "transferencia", UNKNOWN)
SOURCES = ("notification", "pluggy", "ofx", "manual", "uber")


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "double": T.DoubleType(), "money": MONEY}


def _table(spec: str) -> T.StructType:
    """Types of "name type" pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in map(str.split, spec.split(","))])


ACCOUNTS = _table("id string, name string, type string, balance money, pluggy_item_id string, pluggy_account_id string, created_at timestamp, updated_at timestamp")
TRIPS = _table("id string, origin_address string, destination_address string, driver_name string, duration_seconds int, created_at timestamp")
TRANSACTIONS = _table(
    "id string, account_id string, description string, amount money, date timestamp, category string, source string, "
    "external_id string, latitude double, longitude double, uber_metadata_id string, created_at timestamp, updated_at timestamp"
)
#: What a missing or null column becomes on insert.
DEFAULTS: dict[str, dict[str, object]] = {
    "accounts": {"type": "banco", "balance": 0},
    "transactions": {"category": UNKNOWN, "source": "manual"},
    "trips": {},
}
TABLES = {"accounts": ACCOUNTS, "transactions": TRANSACTIONS, "trips": TRIPS}


def in_domain(col: Column, domain: tuple[str, ...]) -> Column:
    return col.isin(*domain)


def with_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """``df`` with all columns of ``table``: missing ones added, ids generated, defaults and times filled in."""
    now = F.current_timestamp() if now is None else now
    out = []
    for f in TABLES[table].fields:
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        fill = {"id": F.expr("uuid()"), "created_at": now, "updated_at": now}.get(f.name)
        if f.name in DEFAULTS[table]:
            fill = F.lit(DEFAULTS[table][f.name])
        out.append((col if fill is None else F.coalesce(col, fill)).cast(f.dataType).alias(f.name))
    return df.select(*out)
