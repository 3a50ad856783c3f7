"""Mixing sources to target weights by prefix sums of hash-ordered documents.

Every document gets a key from a hash of its id and text, so a source's order
is random but the same on every run.  Rows of one id and text are counted
before anything is ordered, so that no task holds a group of copies.  The keys
are cut into as many ranges as
the rows need; the sizes of each source's ranges are summed first, a
running sum over the ranges (one small row each) gives what comes before a
range, and a running sum within each range does the rest: no task gets a whole
source.  A source is then cut at its exact budget: whole epochs are taken by
every document, the rest by the first documents in key order, the last of them
in part.

Sizes are numbers of words ``[^\x20\x09-\x0D]+``; null and empty texts have
size 0 and take nothing.  The null source is a source of its own, the last.
Rows that repeat are documents of their own: those with the same id and text
follow each other in the order, and which of them is cut is left open.  The driver keeps one number per source, so there may be some
hundred thousand sources, any number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EPOCHS, ROWS, LOT = 3, 5_000, 1 << 16


def n_words(text: str):
    """The number of words, 0 for null."""
    flat = F.trim(F.regexp_replace(F.col(text), r"[ \t-\r]+", " "))
    return F.when(F.length(flat) > 0, F.length(flat) - F.length(F.translate(flat, " ", "")) + 1).otherwise(0).cast("long")


def weight_of(rank: int) -> int:
    """1, 2, 3, repeating, by the place of a source in code-point order."""
    return rank % 3 + 1


def targets(sizes: list[int], weights: list[int], budget: int | None = None, epochs: int = EPOCHS) -> list[float]:
    """Shares of ``budget`` (all sizes' sum) by weight; a target stops at ``epochs`` times its source's size, the excess is shared again by weight."""
    left = float(sum(sizes) if budget is None else budget)
    out: list[float | None] = [None] * len(sizes)
    while free := [i for i, t in enumerate(out) if t is None]:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
        left = max(0.0, left - sum(out[i] for i in over))
    return [t or 0.0 for t in out]


def order_key(key: str, text: str, seed: int = 42):
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def runs(df: DataFrame, key: str, text: str, source: str, epochs: int, seed: int, rows: int) -> DataFrame:
    """What each group of rows with one source, id and text gets: ``n`` rows of ``size``, ``whole`` epochs and ``part`` words more among them all."""
    spark = df.sparkSession
    # a name that is never null, so that joins and windows share one partitioning
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    each = df.select(F.col(key).alias("__id"), F.col(source).alias("__of"), name.alias("__source"), n_words(text).alias("size"), order_key(key, text, seed).alias("__key"), order_key(key, text, seed + 1).alias("__check"))
    group = ["__source", "__of", "__id", "__key", "__check", "size"]
    sized = common.written(each.groupBy(*group).agg(F.count("*").alias("n")), "mixture-sizes")
    totals = sized.groupBy("__of", "__source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("groups")).orderBy(F.col("__of").asc_nulls_last()).collect()
    goal = targets([r["source_size"] for r in totals], [weight_of(i) for i in range(len(totals))], epochs=epochs)
    plan = spark.createDataFrame(
        [(r["__source"], r["source_size"], g, int(g + 1e-9)) for r, g in zip(totals, goal, strict=True)],
        "`__source` string, source_size long, target double, budget long",
    )
    ranges = max(1, -(-sum(r["groups"] for r in totals) // rows))
    # the key's share of the key space, as a range number
    placed = sized.withColumn("__range", F.floor(F.shiftrightunsigned("__key", 33) * F.lit(ranges) / F.lit(1 << 31)).cast("long"))
    words = F.col("size") * F.col("n")
    ahead = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__source", "__range").agg(F.sum(words).alias("s"))
    before = before.withColumn("__before", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s").join(plan, "__source")
    own = Window.partitionBy("__source", "__range").orderBy("__key", "__check", F.col("__id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("__ahead", F.coalesce(F.sum(words).over(own), F.lit(0))).join(before, ["__source", "__range"])
    start = F.col("__before") + F.col("__ahead")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(words, rest - start))
    return run.select(*group, "n", "source_size", "target", whole.alias("whole"), part.cast("long").alias("part"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = EPOCHS, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """A row for each of ``df``: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``mix_key``, the hash that orders its source."""
    # a group's rows are numbered by lots, so that no array grows with a hot group
    each = runs(df, key, text, source, epochs, seed, rows).withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    each = each.withColumn("__in", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(LOT), F.col("n") - F.col("__lot") * LOT) - 1)))
    each = each.withColumn("__nth", F.col("__lot") * LOT + F.col("__in"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("__nth") * F.col("size")))
    return each.select(F.col("__id").alias(key), F.col("__of").alias(source), "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"), F.col("__key").alias("mix_key"))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epochs: int = EPOCHS, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes them; the row at a source's cut is taken whole."""
    found = runs(df, key, text, source, epochs, seed, rows).where("size > 0")
    # of a group's rows the first ``__more`` are taken once more than the others
    found = found.select("__source", "__key", "__check", F.col("whole").alias("__whole"), F.col("n").alias("__n"), F.ceil(F.col("part") / F.col("size")).cast("long").alias("__more"))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    held = df.withColumns({"__source": name, "__key": order_key(key, text, seed), "__check": order_key(key, text, seed + 1)})
    joined = held.join(found.where("__whole + __more > 0"), ["__source", "__key", "__check"])
    even = F.col("__more").isin(0) | (F.col("__more") == F.col("__n"))
    alike = joined.where(even).withColumn("__copies", F.col("__whole") + (F.col("__more") > 0).cast("long"))
    # at most one group of a source is cut; its rows are numbered within the tasks that have them, and those by their counts
    cut = common.written(joined.where(~even).withColumn("__task", F.spark_partition_id()), "mixture-cut")
    group = ["__source", "__key", "__check"]
    inside = Window.partitionBy(*group, "__task").orderBy(F.lit(0))
    tasks = cut.groupBy(*group, "__task").agg(F.count("*").alias("__c"))
    tasks = tasks.select(*group, "__task", F.coalesce(F.sum("__c").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    nth = F.row_number().over(inside) + F.col("__first")
    parted = cut.join(tasks, [*group, "__task"]).withColumn("__copies", F.col("__whole") + (nth <= F.col("__more")).cast("long"))
    every = alike.select(*df.columns, "__copies").unionByName(parted.select(*df.columns, "__copies")).where("__copies > 0")
    return every.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*df.columns)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("source", "mix_key")
