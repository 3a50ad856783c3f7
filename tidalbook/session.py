"""Session settings that the ledger queries expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str | None = None, app: str = "tidalbook", **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name that the driver and all executors share: below ``spark.checkpoint.dir``, or on this machine if Spark runs here alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tidalbook-')}/{what}-{uuid.uuid4().hex}"
