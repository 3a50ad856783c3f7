"""Vector codes: each vector's parts are named by the nearest entries of learned codebooks.

Nearest entries are found by segment-mean lower bounds.  Cut a part and an entry
into blocks of b components; with block means m and residual norms r (the
distance of a block from its own mean) the squared distance is at least the sum
over blocks of ``b (m - m')^2 + (r - r')^2``.  A coarse level with one block
filters all entries, finer levels with more blocks filter those that are left,
always against the exact distance to the entry that the coarse level puts first.
What survives gets exact integer distances; ties go to the lower index.  Bounds
carry slack for rounding, so codes equal those of full scans.

Codebooks start as the parts of the vectors with the smallest ids.  A round is
one pass: tasks find the nearest entries and add up each entry's parts, and send
one row per task and entry.  The driver holds the codebooks only.

Vectors that are null, empty or hold null or non-finite components (also when
scaled) are dropped.  All coded vectors have one length, that of the smallest id
whose length the number of parts divides; vectors of other lengths stay with
null code and errors.  Repeated rows each count; rows without id take part and
come last in the order of ids.  Distances beyond a long count as the largest
long.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, whole


class Codebook:
    """Entries of one part, with block means and residual norms of each level, coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        dims = entries.shape[1]
        self.levels = [n for n in (1, 4, 8) if n == 1 or (n < dims and dims % n == 0)]
        self.kept = [self.summary(entries.astype(float), n) for n in self.levels]
        self.size = np.linalg.norm(entries.astype(float), axis=1)

    @staticmethod
    def summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block means times the root of their length, and residual norms: n x ``blocks`` each."""
        cut = x.reshape(len(x), blocks, x.shape[1] // blocks)
        mean = cut.mean(axis=2)
        return mean * np.sqrt(cut.shape[2]), np.linalg.norm(cut - mean[:, :, None], axis=2)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and squared distance for each row, and the number of exact distances."""
        rows = np.arange(len(x))
        mean, rest = self.summary(x, 1)
        bound = (mean - self.kept[0][0].T) ** 2 + (rest - self.kept[0][1].T) ** 2
        size = np.linalg.norm(x, axis=1)
        first = bound.argmin(axis=1)
        best = whole.squared(x, self.entries[first])
        limit = whole.floats(best, np.inf) * (1 + whole.SLACK)
        slack = whole.SLACK * (size[:, None] + self.size) ** 2
        row, entry = np.nonzero(~(bound - slack > limit[:, None]))  # also where a bound is not a number
        for n, (means, rests) in zip(self.levels[1:], self.kept[1:], strict=True):
            mean, rest = self.summary(x, n)
            bound = ((mean[row] - means[entry]) ** 2).sum(1) + ((rest[row] - rests[entry]) ** 2).sum(1)
            left = ~(bound - slack[row, entry] > limit[row])
            row, entry = row[left], entry[left]
        exact = whole.squared(x[row], self.entries[entry])
        if exact.dtype != best.dtype:
            exact, best = exact.astype(object), best.astype(object)
        # a row's survivors stand together, entries ascending; the first one was never ruled out
        start = np.searchsorted(row, rows)
        least = np.minimum.reduceat(exact, start) if len(x) else best
        hit = exact == least[row]
        index = np.full(len(x), len(self.entries))
        np.minimum.at(index, row[hit], entry[hit])
        return index, least, len(row)


def coded(x: np.ndarray, books: list[Codebook]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indexes and squared distances, part by part."""
    return [book.nearest(part)[:2] for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]


def learned(kept: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> list[Codebook]:
    """Codebooks after ``rounds`` rounds over all of ``kept`` (``id``, ``v``)."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    books = [Codebook(p) for p in np.split(np.array([r["v"] for r in rows]), parts, axis=1)]
    n = len(rows)
    for _ in range(rounds):

        def grouped(b: pa.RecordBatch, books=books):
            x = whole.vectors(b.column(0), dims)
            for p, (part, (index, _)) in enumerate(zip(np.split(x, parts, axis=1), coded(x, books), strict=True)):
                yield p * n + index, part

        count, total = whole.group_sums(kept.select("v"), parts * n, dims // parts, grouped)
        books = [Codebook(whole.floor_means(b.entries, count[p * n : (p + 1) * n], total[p * n : (p + 1) * n])) for p, b in enumerate(books)]
    return books


def codes(df: DataFrame, key: str, vector: str, label: str, by: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    ``error``: the squared distances of a vector's parts, added; ``label_error``: these over all
    vectors of its label, those without label together.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("e"))
    every = common.written(whole.scaled(named, "e", by).select("id", "label", "v"), "codes-kept")
    kind = dict(every.dtypes)["label"]
    first = every.where(F.size("v") % parts == 0).orderBy(F.asc_nulls_last("id"), "v").select(F.size("v")).first()
    if first is None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return every.select(F.col("id").alias(key), *nothing)
    dims = first[0]
    fits = F.size("v") == dims
    books = learned(every.where(fits), dims, parts, entries, rounds)
    sha = whole.digest(np.concatenate([whole.integers(b.entries).ravel() for b in books]))

    def batch(b: pa.RecordBatch) -> dict:
        got = coded(whole.vectors(b.column(2), dims), books)
        wide = max(2, len(f"{len(books[0].entries) - 1:x}"))
        names = ["".join(f"{i:0{wide}x}" for i in row) for row in zip(*(index.tolist() for index, _ in got), strict=True)]
        error = sum(d.astype(object) for _, d in got)
        return {"id": b.column(0), "label": b.column(1), "code": pa.array(names, pa.string()), "error": pa.array(whole.longs(error), pa.int64())}

    made = common.arrow_map(every.where(fits).select("id", "label", "v"), batch, f"id long, label {kind}, code string, error long")
    others = every.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    made = common.written(made.unionByName(others), "codes-made")
    common.delete(every)
    added = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(whole.MOST).cast("decimal(38,0)")).cast("long")
    per_label = made.groupBy(F.col("label").alias("l")).agg(added.alias("label_error"))
    joined = made.join(per_label, made["label"].eqNullSafe(per_label["l"]))
    return joined.select(F.col("id").alias(key), "code", "error", F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(sha).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", by=1024)


def oracle(rounds: int = 4, entries: int = 256) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as materialized (select p, part, v, n, d from (select x.p, x.part, x.v, c.n,
    cast(list_sum(list_transform(list_zip(x.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as bigint) as d from parts x join c{r} c on c.part = x.part)
  qualify row_number() over (partition by p, part order by d, n) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as materialized (select part, n, list(m order by i) as v from (select part, n, i, cast((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) as bigint) as m
    from (select part, n, unnest(v) as y, generate_subscripts(v, 1) as i from a{r}) group by part, n, i) group by part, n),
c{r + 1} as materialized (select c.part, c.n, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on m.part = c.part and m.n = c.n)"""
            )
    return f"""
with kept as materialized (select row_number() over (order by vec_id, v) as p, vec_id, label, v from (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
parts as materialized (select p, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as v from kept, range(4) t(part)),
c0 as materialized (select part, p - 1 as n, v from parts where p <= {entries}),
{", ".join(steps)},
made as (select p, string_agg(lpad(lower(to_hex(n)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by p),
sha as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, n)) as codebooks_sha256 from c{rounds})
select k.vec_id, m.code, m.error, cast(sum(m.error) over (partition by k.label) as bigint) as label_error, s.codebooks_sha256
from kept k join made m on m.p = k.p, sha s"""


ORACLE = oracle()
