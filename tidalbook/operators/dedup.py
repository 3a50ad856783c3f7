"""Duplicates within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

WINDOW_MS = 300_000


#: Times that a list grows to before the next one begins.
PART = 256
#: Times of a chain that one row gathers; longer chains are walked by pointers.
LONG = 4_096
#: Doublings of a level: pointers of a level skip 2^``DOUBLINGS`` of the slices of the level below.
DOUBLINGS = 4


def accepted(times: Column, window_ms: int = WINDOW_MS) -> Column:
    """Of a sorted array of times (ms), those that are kept: a time within the window after the last kept one goes.

    Kept times are gathered in lists of ``PART``, as adding to an array copies it.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("bigint").alias("last"), none.alias("part"), F.array().cast("array<array<bigint>>").alias("parts"))

    def step(kept: Column, t: Column) -> Column:
        full = F.size(kept["part"]) >= PART
        part = F.when(full, F.array(t)).otherwise(F.concat(kept["part"], F.array(t)))
        parts = F.when(full, F.concat(kept["parts"], F.array(kept["part"]))).otherwise(kept["parts"])
        return F.when(kept["last"].isNull() | (t - kept["last"] > window_ms), F.struct(t.alias("last"), part.alias("part"), parts.alias("parts"))).otherwise(kept)

    return F.aggregate(times, start, step, lambda kept: F.concat(F.flatten(kept["parts"]), kept["part"]))


def keep_first_in_window(df: DataFrame, keys: list[str], ms: str, window_ms: int = WINDOW_MS, long: int = LONG) -> DataFrame:
    """Keys and the kept ``ms`` values, greedily in time order; a null key is a key as any other, rows without a time go.

    A gap longer than the window before a row starts a chain, and chains do not
    influence each other, so only a chain's times are gathered, not a key's.
    That needs a key's rows in one task, which is done while no key has more
    than ``long`` rows; else ``keep_first_in_slices`` does the same without.
    """
    df = df.where(F.col(ms).isNotNull()).select(*keys, F.col(ms).cast("long").alias(ms))
    if not df.groupBy(*keys).count().where(F.col("count") > long).isEmpty():
        return keep_first_in_slices(df, keys, ms, window_ms, long)
    w = Window.partitionBy(*keys).orderBy(ms)
    far = F.col(ms) - F.lag(ms).over(w) > window_ms
    chained = df.withColumn("__new", F.coalesce(far.cast("int"), F.lit(1))).withColumn("__chain", F.sum("__new").over(w))
    lists = chained.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(ms)).alias("__t"))
    return lists.select(*keys, F.explode(accepted(F.col("__t"), window_ms)).alias(ms))


def matches(a: DataFrame, b: DataFrame, mine: str, its: str) -> Column:
    """Equal keys (``__key`` and ``k``), nulls included, and equal numbers."""
    return a["__key"].eqNullSafe(b["k"]) & (a[mine] == b[its])


def keep_first_in_slices(df: DataFrame, keys: list[str], ms: str, window_ms: int = WINDOW_MS, long: int = LONG) -> DataFrame:
    """``keep_first_in_window`` for keys with any number of times, all of which may be one chain.

    Time is cut into slices as wide as the window, so that no gap lies inside a
    slice.  Chains of at most ``long`` times are folded in one row each, longer
    ones are walked by pointers.  Of a key only its slices meet in one task,
    whose number the clock bounds.
    """
    names = [f"c{i}" for i in range(len(keys))]
    key = F.struct(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True))).alias("__key")
    times = df.select(key, F.col(ms).alias("__ms")).distinct().withColumn("__slice", F.floor(F.col("__ms") / window_ms))
    slices = times.groupBy("__key", "__slice").agg(F.min("__ms").alias("first"), F.max("__ms").alias("last"), F.count("*").alias("n"))
    order = Window.partitionBy("__key").orderBy("__slice")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) > window_ms, F.lit(True))
    slices = slices.withColumn("starts", starts).withColumn("chain", F.sum(F.col("starts").cast("long")).over(order))
    slices = kept(slices.withColumn("size", F.sum("n").over(Window.partitionBy("__key", "chain"))))

    def within(part: DataFrame) -> DataFrame:
        s = part.select(F.col("__key").alias("k"), F.col("__slice").alias("s"), "chain")
        return times.join(s, matches(times, s, "__slice", "s")).select("__key", "__slice", "__ms", "chain")

    lists = within(slices.where(F.col("size") <= long)).groupBy("__key", "chain").agg(F.array_sort(F.collect_list("__ms")).alias("t"))
    found = lists.select("__key", F.explode(accepted(F.col("t"), window_ms)).alias("__ms"))
    crowded = slices.where(F.col("size") > long)
    if not crowded.isEmpty():
        found = found.unionByName(walked(within(crowded), crowded, window_ms))
    return found.select(*(F.col("__key")[n].alias(c) for c, n in zip(keys, names, strict=True)), F.col("__ms").alias(ms))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs one step."""
    path = scratch(df.sparkSession, "window")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walked(times: DataFrame, slices: DataFrame, window_ms: int) -> DataFrame:
    """``__key``, ``__ms`` of the kept times of long chains; ``slices`` tells each slice's first time and whether a chain starts there.

    The next kept time after t, if t is kept, is the first one after t plus the
    window: in the next slice, or else the first of the slice that follows.
    Each level joins runs of slices: pointers of a level lead out of a run, and
    only times that such a pointer leads to matter on the next level, so levels
    shrink by the length of a run, until one run holds all.  Then the kept times
    are found from the starts down, level by level.  Each step is a join of
    (key, time) with (key, time), so no task depends on how many times a key has.
    """
    # what a time looks for lies in the next slice, or is the first time of the slice after that
    asked = times.select("__key", (F.col("__slice") + 1).alias("__slice"), (F.col("__ms") + window_ms).alias("at"), F.col("__ms").alias("who"))
    there = times.select("__key", "__slice", F.col("__ms").alias("at"), F.lit(None).cast("long").alias("who"))
    # from the latest on; of equal moments who asks comes first, as the window's end is not after itself
    later = Window.partitionBy("__key", "__slice").orderBy(F.desc("at"), F.col("who").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = there.unionByName(asked).withColumn("near", F.min(F.when(F.col("who").isNull(), F.col("at"))).over(later))
    near = near.where("who is not null").select("__key", (F.col("__slice") - 1).alias("__slice"), F.col("who").alias("__ms"), "near")
    order = Window.partitionBy("__key").orderBy("__slice")
    following = lambda i: F.lead(F.struct(F.col("__slice").alias("at"), "first", "starts"), i).over(order)
    after = slices.select(F.col("__key").alias("k"), F.col("__slice").alias("s"), following(1).alias("one"), following(2).alias("two"))
    adjacent = F.col("one.at") == F.col("s") + 1
    to = F.when(F.col("near").isNotNull(), F.struct(F.col("near").alias("first"), F.col("one.starts").alias("starts")))
    to = to.when(adjacent, F.struct("two.first", "two.starts")).otherwise(F.struct("one.first", "one.starts"))
    joined = near.join(after, matches(near, after, "__slice", "s")).withColumn("to", to)
    # a chain ends where the next one starts
    nodes = kept(joined.select("__key", "__ms", F.when(~F.col("to.starts"), F.col("to.first")).alias("next")))
    starts = kept(slices.where("starts").select("__key", F.col("first").alias("__ms")))
    base, width, levels = starts.agg(F.min("__ms")).first()[0], window_ms, []
    while True:
        width *= 2**DOUBLINGS
        run = lambda c, w=width: F.floor((F.col(c) - base) / w)
        inside = run("next") == run("__ms")
        p = kept(nodes.select("__key", "__ms", F.when(inside, F.col("next")).alias("to"), F.when(~inside, F.col("next")).alias("exit")))
        steps = []
        for _ in range(DOUBLINGS):
            steps.append(p)
            q = p.select(F.col("__key").alias("k"), F.col("__ms").alias("m"), F.col("to").alias("to2"), F.col("exit").alias("exit2"))
            p = kept(p.join(q, matches(p, q, "to", "m"), "left").select("__key", "__ms", F.col("to2").alias("to"), F.coalesce("exit", "exit2").alias("exit")))
        levels.append(steps)
        entries = p.where("exit is not null").select("__key", "exit").union(starts).toDF("k", "m").distinct()
        nodes = kept(p.join(entries, matches(p, entries, "__ms", "m"), "left_semi").select("__key", "__ms", F.col("exit").alias("next")))
        if nodes.where("next is not null").isEmpty():
            break
    found = starts
    for steps in reversed(levels):
        for p in steps:  # from all within 2^i - 1 steps to all within 2^(i + 1) - 1
            q = p.where("to is not null").select(F.col("__key").alias("k"), F.col("__ms").alias("m"), "to")
            found = kept(found.unionByName(found.join(q, matches(found, q, "__ms", "m")).select("__key", F.col("to").alias("__ms"))))
    return found


def seen(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return df.join(stored.select(key), key, "left_semi")


def unseen(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return df.join(stored.select(key), key, "left_anti")
