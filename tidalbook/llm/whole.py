"""Exact arithmetic on vectors of whole numbers.

Vectors travel as doubles with whole values, which hold every scaled input
exactly.  Results are exact at any size: doubles do the work where no sum can
reach 2^52, Python's integers do it otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import usable

#: Sums go to the driver in limbs of so many bits and in pieces of so many components; a long holds limbs of 2^31 tasks.
BITS, PIECE = 32, 64
#: The largest distance that a long can say.
MOST = (1 << 63) - 1
#: The share by which a bound may be off in floating point.
SLACK = 1e-9


def scaled(df: DataFrame, vector: str, by: int, into: str = "v") -> DataFrame:
    """Rows whose vector is there and finite throughout, also when scaled, with ``into``: each component x as ``floor(by * x)``."""
    x = F.transform(F.col(vector), lambda x: x.cast("double") * by)
    # Spark's own floor gives a long, which large doubles do not fit; these are whole already
    whole = F.transform(x, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return df.where(usable(vector)).withColumn(into, whole).where(usable(into))


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(y) for y in x.ravel().tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis: int64, or Python's integers if they could be large."""
    far = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    if far * far * x.shape[-1] < 2.0**52:
        d = x.astype(float) - c.astype(float)
        return np.einsum("...i,...i->...", d, d).astype(np.int64)
    d = integers(x) - integers(c)
    return (d * d).sum(axis=-1)


def floats(distances: np.ndarray, beyond: float) -> np.ndarray:
    """As doubles; ``beyond`` for what is larger than doubles are."""
    return distances.astype(float) if distances.dtype == np.int64 else np.array([float(d) if d < 1 << 1023 else beyond for d in distances.ravel()]).reshape(distances.shape)


def longs(distances: np.ndarray) -> np.ndarray:
    """As int64; beyond a long, the largest long."""
    return distances if distances.dtype == np.int64 else np.array([min(MOST, d) for d in distances], np.int64)


def group_sums(rows: DataFrame, n_groups: int, dims: int, grouped: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and exact sums of ``n_groups`` groups of vectors, on the driver: ``n_groups`` x ``dims`` numbers, whatever the rows.

    ``grouped`` gives groups and vectors (n x ``dims``) of a batch, once or several times.  Each task
    adds up its own and sends one row a group, limb and piece.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n_groups, np.int64), np.zeros((n_groups, dims), object)
        for b in batches:
            for group, x in grouped(b):
                count += np.bincount(group, minlength=n_groups)
                if float(np.abs(x).max(initial=0)) * len(x) < 2.0**52:
                    part = np.zeros((n_groups, dims))
                    np.add.at(part, group, x)
                    total += part.astype(np.int64).astype(object)
                else:
                    np.add.at(total, group, integers(x))
        there, limb = np.flatnonzero(count), 0
        rest = total[there]
        while len(there):
            last = abs(rest).max() < 1 << (BITS - 1)
            low = rest if last else rest & ((1 << BITS) - 1)
            for at in range(0, dims, PIECE):
                sums = pa.array([r.tolist() for r in low[:, at : at + PIECE]], pa.list_(pa.int64()))
                n = pa.array(count[there] if limb == at == 0 else np.zeros(len(there), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([limb] * len(there), pa.int32()), pa.array([at] * len(there), pa.int32()), n, sums], ["g", "limb", "at", "n", "s"])
            if last:
                break
            rest, limb = rest >> BITS, limb + 1
        common.release()

    common.small_batches(rows.sparkSession)
    parts = rows.mapInArrow(add, "g int, limb int, at int, n long, s array<long>")
    width = min(PIECE, dims)
    added = parts.groupBy("g", "limb", "at").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)))
    count, total = np.zeros(n_groups, np.int64), np.zeros((n_groups, dims), object)
    for r in added.collect():
        count[r["g"]] += r["n"]
        for i in range(min(width, dims - r["at"])):
            total[r["g"], r["at"] + i] += r[f"s{i}"] << (BITS * r["limb"])
    return count, total


def floor_means(old: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Componentwise ``floor(sum / count)`` of each group, the old vector of a group without rows: doubles if these are exact."""
    new = integers(old)
    for g in np.flatnonzero(count):
        new[g] = total[g] // int(count[g])
    return new.astype(float) if not new.size or abs(new).max() < 1 << 52 else new


def digest(components: np.ndarray) -> str:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in components.ravel().tolist()).encode()).hexdigest()
