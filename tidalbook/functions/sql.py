"""The ledger's functions for SQL: temporary functions of the session, made from the same Column expressions.

They are SQL functions, so Spark puts their bodies into the plan: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates, geo, text

_c = F.col
#: Name, arguments and body of each scalar function.
SCALARS = {
    "categorize": ("description string", lambda: text.categorize_by_patterns(_c("description"))),
    "category_label": ("category string", lambda: text.label_of(_c("category"))),
    "parse_amount": ("value string", lambda: text.parse_amount(_c("value"))),
    "extract_amount": ("value string", lambda: text.extract_amount(_c("value"))),
    "format_brl": ("amount decimal(15,2)", lambda: text.format_brl(_c("amount"))),
    "format_moment": ("moment timestamp", lambda: text.format_moment(_c("moment"))),
    "dedup_hash": ("amount decimal(15,2), bank string, moment string", lambda: text.dedup_hash(_c("amount"), _c("bank"), _c("moment"))),
    "detect_bank": ("title string, body string", lambda: text.detect_bank(_c("title"), _c("body"))),
    "is_purchase": ("title string, body string", lambda: text.is_purchase(_c("title"), _c("body"))),
    "extract_merchant": ("body string", lambda: text.extract_merchant(_c("body"))),
    "trip_description": ("origin string, destination string", lambda: text.trip_description(_c("origin"), _c("destination"))),
    "parse_ofx_date": ("value string, now string", lambda: dates.parse_ofx_date(_c("value"), _c("now"))),
    "distance_meters": ("lat1 double, lng1 double, lat2 double, lng2 double", lambda: geo.distance(_c("lat1"), _c("lng1"), _c("lat2"), _c("lng2"))),
}


def body(spark: SparkSession, arguments: str, made: Column) -> tuple[str, str]:
    """The SQL text and the type of an expression over ``arguments``."""
    df = spark.createDataFrame([], arguments).select(made.alias("x"))
    return df._jdf.queryExecution().analyzed().projectList().apply(0).child().sql(), df.schema[0].dataType.simpleString()


def register(spark: SparkSession, ledger: str | None = None) -> list[str]:
    """Makes the scalar functions, and for a table or view ``ledger`` the table function ``nearby(lat, lng, radius)``; returns their names."""
    for name, (arguments, make) in SCALARS.items():
        sql, kind = body(spark, arguments, make())
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {sql}")
    if ledger is None:
        return list(SCALARS)
    # the box of a radius lets the scan prune; the exact distance decides
    spark.sql(f"""
        create or replace temporary function nearby(lat double, lng double, radius double default {geo.DEFAULT_RADIUS})
        returns table (id string, account_id string, description string, amount decimal(15,2), date timestamp, category string, source string, latitude double, longitude double, distance_meters double)
        return select id, account_id, description, amount, date, category, source, latitude, longitude, m as distance_meters
        from (select *, distance_meters(nearby.lat, nearby.lng, latitude, longitude) as m from {ledger}
              where latitude between nearby.lat - nearby.radius / 110000 and nearby.lat + nearby.radius / 110000 and longitude is not null)
        where m <= nearby.radius order by m, id limit {geo.MOST}""")
    return [*SCALARS, "nearby"]
