"""Centroid clustering (Lloyd's rounds) with Hamerly bounds.

Each vector carries its centroid, one upper bound on the distance to it and one
lower bound on the distance to the second nearest.  When centroids move, the
upper bound grows by what its own centroid drifted and the lower bound shrinks
by the largest drift of the others.  A vector stays where it is if its upper
bound lies below its lower bound, or below half the way from its centroid to
the nearest other one.  Else the upper bound is made exact and tried again;
vectors that are still ambiguous get a full scan in exact integers.  Bounds
carry slack for rounding, so results equal those of full scans.

A round is two passes without a shuffle of vectors: one assigns and writes
vectors with their bounds, one adds up each centroid's vectors within tasks and
sends a row per task and centroid.  The driver holds the centroids only.

Vectors that are null, hold null or non-finite components (also when scaled) or
have another length than ``dims`` take no part.  Ties go to the centroid with
the smaller number.  Repeated rows each count.  Rows without id take part, and
start as centroids only if rows with ids are fewer than centroids.  Distances
beyond a long count as the largest long.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, whole


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, in that order; fewer if there are fewer rows."""
    hashed = kept.select("id", "v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    rows = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows])


def root_up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(whole.floats(d, np.inf)) * (1 + whole.SLACK)


def root_down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(whole.floats(d, 2.0**1023)) * (1 - whole.SLACK)


class Moves:
    """Centroids of a round and what bounds need of them: drifts since the last round and half the way to the nearest other."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        k = len(now)
        between = [np.delete(whole.squared(now, np.broadcast_to(c, now.shape)), i) for i, c in enumerate(now)]
        self.half = np.array([root_down(b).min(initial=np.inf) / 2 for b in between])
        self.drift = np.zeros(k) if before is None else root_up(whole.squared(now, before))
        self.others = np.array([np.delete(self.drift, i).max(initial=0.0) for i in range(k)])

    def to_all(self, x: np.ndarray) -> np.ndarray:
        d = [whole.squared(x, np.broadcast_to(c, x.shape)) for c in self.now]
        plain = all(y.dtype == np.int64 for y in d)
        return np.stack(d if plain else [y.astype(object) for y in d], axis=1)

    def to_own(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return whole.squared(x, self.now[own])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings ``own`` and the bounds up to date, in place; the places that took full scans."""
        upper += self.drift[own]
        lower -= self.others[own]
        wall = np.maximum(lower, self.half[own])
        open_ = np.flatnonzero(~(upper < wall))  # also where a bound is not a number
        upper[open_] = root_up(self.to_own(x[open_], own[open_]))
        open_ = open_[~(upper[open_] < wall[open_])]
        self.scan(x, own, upper, lower, open_)
        return open_

    def scan(self, x, own, upper, lower, at: np.ndarray) -> None:
        if not len(at):
            return
        d = self.to_all(x[at])
        best = d.argmin(axis=1)  # the first of equals
        rows = np.arange(len(at))
        own[at], upper[at] = best, root_up(d[rows, best])
        low = root_down(d)
        low[rows, best] = np.inf
        lower[at] = low.min(axis=1)


STATE = "id long, v array<double>, own int, upper double, lower double, scanned boolean"


def assigned(rows: DataFrame, moves: Moves, dims: int, fresh: bool) -> DataFrame:
    """``rows`` with their centroids and bounds brought up to date; ``fresh``: they have none yet."""

    def batch(b: pa.RecordBatch) -> dict:
        x = whole.vectors(b.column(1), dims)
        n = len(x)
        if fresh:
            own, upper, lower = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            looked = np.arange(n)
            moves.scan(x, own, upper, lower, looked)
        else:
            own, upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("own", "upper", "lower"))
            looked = moves.assign(x, own, upper, lower)
        scanned = np.zeros(n, bool)
        scanned[looked] = True
        return {"id": b.column(0), "v": b.column(1), "own": pa.array(own, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower), "scanned": pa.array(scanned)}

    return common.arrow_map(rows, batch, STATE)


def clusters(df: DataFrame, key: str, vector: str, k: int, rounds: int, dims: int, by: int, seed: int = 1) -> DataFrame:
    """``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` and ``scanned``: whether the last pass had to look at all centroids."""
    spark = df.sparkSession
    named = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"))
    state = common.written(whole.scaled(named.where(F.size("e") == dims), "e", by).select("id", "v"), "clusters-kept")
    centroids = first_centroids(state, k, seed)
    out = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean"
    if not len(centroids):
        return spark.createDataFrame([], out)
    moves = Moves(centroids)
    for turn in range(rounds + 1):
        before, state = state, common.written(assigned(state, moves, dims, turn == 0), "clusters-state")
        common.delete(before)
        if turn < rounds:
            sums = whole.group_sums(state.select("own", "v"), len(centroids), dims, lambda b: [(b.column(0).to_numpy(), whole.vectors(b.column(1), dims))])
            moves = Moves(whole.floor_means(moves.now, *sums), moves.now)

    def measure(b: pa.RecordBatch) -> dict:
        own = b.column("own").to_numpy()
        d = whole.longs(moves.to_own(whole.vectors(b.column("v"), dims), own))
        return {"id": b.column("id"), "own": b.column("own"), "distance": pa.array(d, pa.int64()), "scanned": b.column("scanned")}

    measured = common.arrow_map(state, measure, "id long, own int, distance long, scanned boolean")
    measured = common.written(measured, "clusters-measured")
    common.delete(state)
    added = measured.groupBy("own").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a number a centroid
    own = {r["own"]: int(r["d"]) for r in added}
    final = [(i, min(own.get(i, 0), whole.MOST), min(sum(own.values()), whole.MOST), whole.digest(c)) for i, c in enumerate(moves.now)]
    per_centroid = spark.createDataFrame(final, "own int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = measured.join(F.broadcast(per_centroid), "own")  # ``k`` rows
    return joined.select(F.col("id").alias(key), F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clusters(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=16, rounds=3, dims=64, by=64)
    return made.drop("scanned")


def oracle(rounds: int = 3, k: int = 16) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select p, vec_id, v, n, d from (select x.p, x.vec_id, x.v, c.n,
    cast(list_sum(list_transform(list_zip(x.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as bigint) as d from kept x, c{r} c)
  qualify row_number() over (partition by p order by d, n) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as materialized (select n, list(m order by i) as v from (select n, i, cast((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) as bigint) as m
    from (select n, unnest(v) as y, generate_subscripts(v, 1) as i from a{r}) group by n, i) group by n),
c{r + 1} as materialized (select c.n, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on m.n = c.n)"""
            )
    return f"""
with kept as materialized (select row_number() over () as p, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as n, v from kept qualify n < {k}),
{", ".join(steps)},
t as (select n, sum(d) as s from a{rounds} group by n)
select a.vec_id, cast(a.n as integer) as cluster, a.d as distance, cast(t.s as bigint) as cluster_inertia, cast((select sum(s) from t) as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join t on t.n = a.n join c{rounds} c on c.n = a.n"""


ORACLE = oracle()
