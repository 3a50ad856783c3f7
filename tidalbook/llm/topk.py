"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data share the top level of one cover tree: at most ``CELLS``
centres, spread over a sample of ``SAMPLE`` data vectors.  Each vector belongs to its nearest centre's
cell; a cell's data are cut into blocks and its queries into groups, whose
covering radii are measured.  For a node with centre q and radius s over
queries and a node with centre c and radius r over data no inner product
exceeds ``<q,c> + |q| r + s |c| + s r``.

1. Each query group is searched in one block of its own cell (if there is one),
   which gives every query a first k-th score.
2. Groups meet the blocks whose bound is no less than the group's worst k-th
   score; bounds are first taken between cells, then between groups and blocks,
   on small summaries, before any vector is moved.  A block's vectors then move
   once, a group's once for each block it still has to meet.
3. Within a block both sides get a cover tree of their own, radii half as large on each level down, and node
   pairs are visited best bound first and dropped below the worst k-th score of
   the query node.  What beats a query's first k-th score is ranked with it.

Scores are integer inner products, computed exactly: in doubles where no sum can
reach 2^53, else in whole numbers of any size.  A score beyond a long counts as
the largest or smallest one.  Ties go to the smaller id.  Vectors that are null,
empty or hold null or non-finite components, also after scaling, take no part;
vectors of different lengths are never compared; rows that share the query's id
are not its candidates; query rows that share an id are ranked together.
Queries without candidates return nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors of a data block and of a query group, and points under which a node is a leaf.
BLOCK, QUERIES, LEAF = 4096, 512, 48
#: Vectors that centres are chosen from, and centres per length of vector, at most.
SAMPLE, CELLS = 4096, 64
#: No score (yet), the largest score that counts, and the share by which a bound may be off in floating point.
NONE, MOST, SLACK = -(1 << 63), (1 << 63) - 2, 1e-9


class CoverTree:
    """Nodes as lists: centre, covering radius, children, and points (leaves only)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        index = np.arange(len(points))
        far = np.linalg.norm(points - points[0], axis=1)
        self.root = self.grow(0, index, far)
        self.norm = np.linalg.norm(points, axis=1)

    def grow(self, centre: int, index: np.ndarray, far: np.ndarray) -> int:
        """A node over ``index``, whose points lie ``far`` from the centre."""
        me = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.children.append([])
        self.members.append(None)
        if len(index) <= self.leaf or not 1e-9 < self.radius[me] < np.inf:
            self.members[me] = index
            return me
        reach = self.radius[me] / 2
        groups = []
        while len(index):  # centres of the next level lie more than ``reach`` apart
            near = far <= reach
            if not near.any():
                centre = int(index[np.argmax(far)])
                far = np.linalg.norm(self.points[index] - self.points[centre], axis=1)
                near = far <= reach
            groups.append((centre, index[near], far[near]))
            index, far = index[~near], far[~near]
            if len(index):
                centre = int(index[0])
                far = np.linalg.norm(self.points[index] - self.points[centre], axis=1)
        # lone points hang together in one leaf under this node, so that they are compared at once
        lone = [g[1] for g in groups if len(g[1]) <= 2]
        for g in groups:
            if len(g[1]) > 2:
                self.children[me].append(self.grow(*g))
        if lone:
            rest = np.concatenate(lone)
            centre = self.centre[me]
            leaf = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(np.linalg.norm(self.points[rest] - self.points[centre], axis=1).max()))
            self.children.append([])
            self.members.append(rest)
            self.children[me].append(leaf)
        return me


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All inner products of whole-number vectors (rows of float64) as int64, clamped to ``MOST``."""
    if not len(q) or not len(d):
        return np.zeros((len(q), len(d)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < 2.0**53:
        return (q @ d.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (q.tolist(), d.tolist())]
    return np.array([[max(-MOST, min(MOST, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64)


def bound_of(dot, q_norm, c_norm, s, r):
    """What no inner product within the two radii exceeds, whatever floating point has lost."""
    top = dot + q_norm * r + s * c_norm + s * r  # not a number if doubles overflow; that exceeds everything
    return top + SLACK * (q_norm * c_norm + q_norm * r + s * c_norm + s * r) + 1e-6


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (n queries x k, best first); a missing place has score ``NONE``.

    What lies below a query's ``floor`` (int64) may be left out.
    """
    n = len(query_ids)
    best = np.full((n, k), NONE)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    kth = np.full(n, NONE) if floor is None else floor.copy()
    under: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries.centre)
    for v in range(len(queries.centre) - 1, -1, -1):  # children have larger numbers
        parts = [under[c] for c in queries.children[v]] + ([queries.members[v]] if queries.members[v] is not None else [])
        under[v] = np.concatenate(parts)

    def bound(q: int, d: int) -> float:
        a, b = queries.centre[q], data.centre[d]
        top = float(bound_of(queries.points[a] @ data.points[b], queries.norm[a], data.norm[b], queries.radius[q], data.radius[d]))
        return top if top == top else np.inf

    heap = [(-bound(queries.root, data.root), queries.root, data.root)]
    while heap:
        top, q, d = heapq.heappop(heap)
        if -top < kth[under[q]].min():
            continue
        ql, dl = queries.members[q] is not None, data.members[d] is not None
        if ql and dl:
            rows, cols = queries.members[q], data.members[d]
            rows = rows[kth[rows] <= -top]
            got = products(queries.points[rows], data.points[cols])
            got[query_ids[rows][:, None] == data_ids[cols][None, :]] = NONE
            score = np.concatenate((best[rows], got), axis=1)
            name = np.concatenate((ids[rows], np.broadcast_to(data_ids[cols], got.shape)), axis=1)
            order = np.lexsort((name, ~score), axis=1)[:, :k]
            best[rows], ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
        elif ql or (not dl and data.radius[d] >= queries.radius[q]):
            for c in data.children[d]:
                heapq.heappush(heap, (-bound(q, c), q, c))
        else:
            for c in queries.children[q]:
                heapq.heappush(heap, (-bound(c, d), c, d))
    return ids, best


def usable(vector: str):
    """Column: the vector is there, not empty and finite throughout."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the points, each as far as can be from those before it."""
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def centres_of(data: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Centres by length of vector, from the ``SAMPLE`` vectors with the smallest hashes; ``rows``: vectors in all.

    Hashes far above those are left out first, so that no task sends the driver more than its share.
    """
    hashed = data.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "v"), 11))
    share = 2 * SAMPLE / max(1, rows)
    if share < 1:
        hashed = hashed.where(F.col("h") <= int(share * (1 << 53)))
    sample: dict[int, list] = {}
    for r in hashed.orderBy("h", "id").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    return {d: spread(np.array(x), min(CELLS, max(1, -(-rows // BLOCK)))) for d, x in sample.items()}


def dealt(df: DataFrame, centres: dict[int, np.ndarray], rows: int, name: str) -> DataFrame:
    """Vectors gathered by cell in lots of about ``rows``: ``dims``, ``cell``, ``lot``, ``radius``, ids and vectors.

    Lengths that the sample does not have get the origin as their centre.
    """

    def batch(b: pa.RecordBatch) -> dict:
        v = b.column(1)
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        start, flat = v.offsets.to_numpy()[:-1], v.values.to_numpy(zero_copy_only=False)
        cell, far = np.zeros(len(size), np.int32), np.zeros(len(size))
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            x = flat[start[at][:, None] + np.arange(d)]
            apart = np.column_stack([np.linalg.norm(x - c, axis=1) for c in centres.get(d, np.zeros((1, d)))])
            cell[at], far[at] = apart.argmin(1), apart.min(1)
        return {"id": b.column(0), "v": v, "dims": pa.array(size, pa.int32()), "cell": pa.array(cell), "far": pa.array(far)}

    placed = common.arrow_map(df.select("id", "v"), batch, "id long, v array<double>, dims int, cell int, far double")
    # numbered as they lie in the written table, so that a task that runs again numbers its rows alike
    placed = common.written(placed, f"{name}-cells").withColumn("at", F.monotonically_increasing_id())
    lots = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / rows).alias("lots"))
    placed = placed.join(lots, ["dims", "cell"]).withColumn("lot", F.pmod(F.xxhash64("id", "v", "at"), F.col("lots")))
    made = placed.groupBy("dims", "cell", "lot").agg(F.max("far").alias("radius"), F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    return common.written(made, name)


def reach(spark: SparkSession, centres: dict[int, np.ndarray], dims: DataFrame) -> DataFrame:
    """What a bound between two cells needs (``dims``, ``q_cell``, ``cell``, ``dot``, ``q_norm``, ``c_norm``): at most ``CELLS`` squared rows a length."""
    rows = []
    for d, c in centres.items():
        dot, norm = c @ c.T, np.linalg.norm(c, axis=1)
        rows += [(d, i, j, float(dot[i, j]), float(norm[i]), float(norm[j])) for i in range(len(c)) for j in range(len(c))]
    known = spark.createDataFrame(rows, "dims int, q_cell int, cell int, dot double, q_norm double, c_norm double")
    zero, none = F.lit(0), F.lit(0.0)
    other = (dims.where(~F.col("dims").isin(*centres)) if centres else dims).select("dims", zero.alias("q_cell"), zero.alias("cell"), none.alias("dot"), none.alias("q_norm"), none.alias("c_norm"))
    return known.unionByName(other)


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; both inputs have ``id`` (long) and ``v`` (array of doubles with whole values)."""
    spark = data.sparkSession
    queries, data = (x.select("id", F.col("v").cast("array<double>").alias("v")) for x in (queries, data))
    rows = data.count()
    centres = centres_of(data, rows)
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, groups = dealt(data, centres, BLOCK, "topk-data"), dealt(queries, centres, QUERIES, "topk-queries")
    task = ["dims", "cell", "lot"]
    n = common.n_partitions(spark)
    kind = "dims int, cell int, lot long, turn int, radius double, q_cell int, q_lot long, ids array<long>, vs array<double>, floor array<long>"

    def met(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows for ``search``: each block that has a pair, followed by its query groups."""
        there = blocks.join(pairs.select(*task).distinct(), task, "left_semi")
        nothing = F.lit(None)
        own = there.select(*task, F.lit(0).alias("turn"), "radius", nothing.cast("int").alias("q_cell"), nothing.cast("long").alias("q_lot"), "ids", "vs", nothing.cast("array<long>").alias("floor"))
        asked = groups.select("dims", F.col("cell").alias("q_cell"), F.col("lot").alias("q_lot"), F.lit(1).alias("turn"), "radius", "ids", "vs", "floor")
        asked = pairs.join(asked, ["dims", "q_cell", "q_lot"]).select(own.columns)
        return own.unionByName(asked).repartition(n, *task).sortWithinPartitions(*task, "turn")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = names = None
        for b in batches:
            for i in range(b.num_rows):
                dims = b.column("dims")[i].as_py()
                ids = b.column("ids")[i].values.to_numpy(zero_copy_only=False)
                own = CoverTree(b.column("vs")[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims))
                if b.column("turn")[i].as_py() == 0:
                    tree, names = own, ids
                    continue
                floor = b.column("floor")[i].values
                found, score = dual_search(own, ids, tree, names, k, floor if floor is None else floor.to_numpy(zero_copy_only=False))
                at = [pa.array([b.column(c)[i].as_py()] * len(ids), t) for c, t in (("dims", pa.int32()), ("q_cell", pa.int32()), ("q_lot", pa.int64()))]
                lists = [pa.ListArray.from_arrays(np.arange(0, k * len(ids) + 1, k, dtype=np.int32), x.ravel()) for x in (found, score)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids), *lists], ["dims", "cell", "lot", "place", "query_id", "vec_ids", "scores"])

    found = "dims int, cell int, lot long, place int, query_id long, vec_ids array<long>, scores array<long>"
    first = groups.select(*task).join(blocks.where("lot = 0").select("dims", "cell"), ["dims", "cell"])
    first = first.select("dims", "cell", F.lit(0).cast("long").alias("lot"), F.col("cell").alias("q_cell"), F.col("lot").alias("q_lot"))
    seeded = common.written(met(first, groups.withColumn("floor", F.lit(None).cast("array<long>"))).mapInArrow(search, found), "topk-seeds")
    # the k-th score of each query of a group, in its order, and the worst of them
    kth = seeded.groupBy(*task).agg(F.array_sort(F.collect_list(F.struct("place", F.element_at("scores", k).alias("s")))).alias("f"))
    kth = kth.select(*task, F.col("f.s").alias("floor"), F.array_min("f.s").alias("worst"))
    groups = groups.join(kth, task, "left").withColumn("seeded", F.col("floor").isNotNull())
    asking = groups.select("dims", F.col("cell").alias("q_cell"), F.col("lot").alias("q_lot"), F.col("radius").alias("s"), F.coalesce("worst", F.lit(NONE)).alias("worst"), "seeded")
    top = lambda r: bound_of(F.col("dot"), F.col("q_norm"), F.col("c_norm"), F.col("s"), F.col(r))
    cells = blocks.groupBy("dims", "cell").agg(F.max("radius").alias("widest"))
    near = asking.join(reach(spark, centres, cells.select("dims").distinct()), ["dims", "q_cell"]).join(cells, ["dims", "cell"]).where(top("widest") >= F.col("worst"))
    pairs = near.join(blocks.select(*task, "radius"), ["dims", "cell"]).where((top("radius") >= F.col("worst")) & ~(F.col("seeded") & (F.col("lot") == 0) & (F.col("cell") == F.col("q_cell"))))
    later = met(common.written(pairs.select(*task, "q_cell", "q_lot"), "topk-pairs"), groups).mapInArrow(search, found)
    every = seeded.unionByName(later).select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).where(F.col("x.scores") > NONE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled(df: DataFrame, key: str, vector: str, by: int) -> DataFrame:
    """Usable vectors with each component x as ``floor(by * x)``, a double with a whole value."""
    # Spark's own floor gives a long, which large doubles do not fit; these are whole already
    whole = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double") * by) < 2.0**52, F.floor(x.cast("double") * by).cast("double")).otherwise(x.cast("double") * by))
    made = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    return made.where(usable("v"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = scaled(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return top_k(data.where("id % 100 = 0"), data, 10)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
           from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10"""
