"""Tables on shared storage that batches change part by part, and results kept under their batch's number.

Both make a batch that runs again harmless, so a stream that dies between its
write and its commit gives every row once.  They are Parquet folders that any
Spark job reads; nothing here needs a table format.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import writes


def numbers(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet folder, or None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


@dataclass(frozen=True)
class KeyedTable:
    """A table cut into ``parts`` folders by a hash of its key; a batch reads and replaces those that it touches.

    ``parts`` is for the table's owner to choose so that a part is some 100 MB.
    Rows with a null key never meet each other; they are dealt by a hash of the row.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "external_id"
    parts: int = 64

    @property
    def with_part(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])

    def part(self) -> Column:
        key = F.col(self.key)
        return F.pmod(F.when(key.isNull(), F.xxhash64(*self.schema.names)).otherwise(F.xxhash64(key)), F.lit(self.parts)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their ``part``, one task a part, so that a part is one file."""
        shaped = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))
        return shaped.withColumn("part", self.part())

    def create(self, rows: DataFrame | None = None) -> KeyedTable:
        """Writes the table anew with these rows."""
        rows = self.spark.createDataFrame([], self.schema) if rows is None else rows
        self.dealt(rows).repartition(self.parts, "part").write.mode("overwrite").partitionBy("part").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.with_part).parquet(self.path).drop("part")

    def touched(self, batch: DataFrame) -> list[int]:
        """The parts that a batch's keys are in: ``parts`` numbers at most."""
        return sorted(r["part"] for r in self.dealt(batch).select("part").distinct().collect())

    def merge(self, batch: DataFrame, batch_id: int | str | None = None, order: tuple[str, ...] = ("date",), overwritten: tuple[str, ...] = writes.OVERWRITTEN) -> dict[str, int]:
        """Upserts ``batch``; gives the numbers of rows ``added`` and ``updated``.

        The new parts are written beside the table first, then marked with the
        batch's number, then put in place of the old ones.  A batch of the marked
        number is only put in place again: parts that a crash left half replaced
        become whole, and nothing is merged twice.
        """
        batch_id = str(uuid.uuid4() if batch_id is None else batch_id)
        beside, mark = f"{self.path}-next", f"{self.path}-mark"
        kind = T.StructType([T.StructField("batch", T.StringType()), *numbers("added", "updated")])
        done = stored(self.spark, mark, kind)
        last = done.where(F.col("batch") == batch_id).first() if done is not None else None
        if last is None:
            batch = batch.persist()
            parts = self.touched(batch)
            there = self.spark.read.schema(self.with_part).parquet(self.path).where(F.col("part").isin(parts))
            marked = writes.upserted(there.drop("part"), batch, self.key, order, overwritten)
            seen = Observation()
            rows = marked.withColumn("part", self.part()).repartition(max(1, len(parts)), "part")
            # in the last stage, whose tasks count once however often they run
            rows = rows.observe(seen, F.count_if(F.col("how") == "added").alias("added"), F.count_if(F.col("how") == "updated").alias("updated"))
            rows.drop("how").write.mode("overwrite").partitionBy("part").parquet(beside)
            batch.unpersist()
            last = {"added": seen.get["added"], "updated": seen.get["updated"]}
            self.spark.createDataFrame([(batch_id, last["added"], last["updated"])], kind).coalesce(1).write.mode("overwrite").parquet(mark)
        fresh = self.spark.read.schema(self.with_part).parquet(beside)
        put = fresh.repartition(self.parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        put.partitionBy("part").parquet(self.path)
        return {"added": last["added"], "updated": last["updated"]}


@dataclass(frozen=True)
class BatchSink:
    """Results under the number of the batch that gave them; a batch that runs again replaces its own."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        """All rows, with ``batch``."""
        kind = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        rows = stored(self.spark, self.path, kind)
        return self.spark.createDataFrame([], kind) if rows is None else rows


#: What ``counted`` gives.
COUNTERS = numbers("total", "imported", "skipped")


def counted(marked: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows that ``writes.marked_imports`` takes, and an observation that whoever writes them reads the counters from.

    One pass imports and counts.  The counts are taken in the last stage, whose tasks count once however often they run.
    """
    seen = Observation()
    both = marked.observe(seen, F.count("*").alias("total"), F.count_if("imported").alias("imported"))
    return both.where("imported").drop("imported"), seen


def counters(seen: Observation) -> tuple[int, int, int]:
    """``total``, ``imported``, ``skipped``; waits until the rows are written."""
    total, imported = seen.get["total"], seen.get["imported"]
    return total, imported, total - imported
