"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the cluster's owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the session's checkpoint folder.

    Set here only when nothing has set it and Spark runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidalbook-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Removes the files behind a table made by ``written``."""
    spark = df.sparkSession
    root = shared_dir(spark)
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if root.split(":", 1)[-1].lstrip("/") in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch and of what a function of one batch gets at a time.
ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of this session to ``ROWS`` rows, unless it asks for fewer.

    A batch lies in the executor's memory twice, outside the heap and in Python, and texts may be long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def release() -> None:
    """Gives freed memory back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str, at_end: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns a dict of columns; ``at_end`` runs when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                out = per_batch(whole.slice(i, ROWS))
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        if at_end is not None:
            at_end()
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_made(df: DataFrame, column: str, into: str, kind: str, make: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` with one more column ``into`` that ``make`` gives for a batch's values of ``column``; a column of that name, in any case, is replaced."""
    kept = [c for c in df.columns if c.lower() != into.lower()]
    kinds = dict(df.dtypes)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:-1], make(b.columns[-1].to_pylist())], [*kept, into])

    quoted = ["`" + c.replace("`", "``") + "`" for c in kept]
    schema = ", ".join([*(f"{q} {kinds[c]}" for q, c in zip(quoted, kept, strict=True)), f"`{into}` {kind}"])
    # plain names on the way: Spark's Arrow functions don't take names with dots
    plain = [F.col(q).alias(f"c{i}") for i, q in enumerate(quoted)]
    return arrow_map(df.select(*plain, F.col(column).alias("text")), batch, schema)
