import hashlib
import math
import random

import numpy as np
import pytest

from tidalbook.llm import clusters, whole

KIND = "vec_id long, embedding array<double>, own string, v string"


def brute(rows, k, rounds, dims, by):
    """Full scans in Python's integers."""
    kept = [(i, [math.floor(by * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    top = whole.MOST
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, n, min(d, top), min(total[n], top), min(sum(total.values()), top), sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True))


def run(spark, rows, k=4, rounds=3, dims=3, by=64):
    df = spark.createDataFrame([(i, e, "clash", "clash") for i, e in rows], KIND)
    got = clusters.clusters(df, "vec_id", "embedding", k, rounds, dims, by).collect()
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got), got


@pytest.mark.parametrize("kind", ["random", "ties", "clumps"])
def test_against_full_scans(spark, kind):
    rng = random.Random(3)
    make = {"random": lambda i: [rng.uniform(-2, 2) for _ in range(3)], "ties": lambda i: [float(rng.randrange(2)) for _ in range(3)], "clumps": lambda i: [10.0 * (i % 5) + rng.random(), float(i % 5), -0.001]}[kind]
    rows = [(i, make(i)) for i in range(400)]
    got, full = run(spark, rows)
    assert got == brute(rows, 4, 3, 3, 64)
    if kind == "clumps":  # bounds spare most vectors a scan
        assert sum(r["scanned"] for r in full) < len(rows) / 4


def test_odd_rows(spark):
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 0.0]), (903, [1.0, 2.0, float("-inf")]), (904, [1.0, 2.0]), (905, []), (906, [1.0] * 4)]
    good = [(1, [0.1, -0.1, 0.5]), (1, [0.1, -0.1, 0.5]), (2, [1.0, 1.0, 1.0]), (None, [5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.0]), (3, [-7.0, 0.0, 0.0])]
    for k in (1, 2, 3, 9):
        assert run(spark, bad + good, k)[0] == brute(bad + good, k, 3, 3, 64)


def test_empty_table(spark):
    got, _ = run(spark, [])
    assert got == [] and run(spark, [(1, None)])[0] == []


@pytest.mark.parametrize("size", [1e9, 1e17, 1e30, 1e150, 1e300])
def test_numbers_of_any_size(spark, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size), float(i), 0.5]) for i in range(60)]
    assert run(spark, rows)[0] == brute(rows, 4, 3, 3, 64)


def test_bounds_never_lie():
    """Through many rounds the upper bound stays above the distance, the lower below the second one."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 6)) * 40)
    moves = clusters.Moves(x[:9])
    own, upper, lower = np.zeros(500, np.int32), np.zeros(500), np.zeros(500)
    moves.scan(x, own, upper, lower, np.arange(500))
    spared = 0
    for _ in range(12):
        moves = clusters.Moves(np.floor(np.array([x[own == c].mean(0) if (own == c).any() else moves.now[c] for c in range(9)])), moves.now)
        spared += 500 - len(moves.assign(x, own, upper, lower))
        d = np.sqrt(((x[:, None] - moves.now) ** 2).sum(2))
        assert (own == d.argmin(1)).all() and (upper >= d[np.arange(500), own]).all()
        assert (lower <= np.sort(d, axis=1)[:, 1]).all()
    assert spared > 2000


def test_sums_are_exact_over_limbs_and_pieces(spark):
    big = [(i, [float((-1) ** i * 2**k + i) for k in range(30, 96)]) for i in range(50)]
    df = spark.createDataFrame(big, "g int, v array<double>").repartition(3)
    count, total = whole.group_sums(df, 50, 66, lambda b: [(b.column(0).to_numpy() % 7, whole.vectors(b.column(1), 66))])
    for g in range(7):
        own = [v for i, v in big if i % 7 == g]
        assert count[g] == len(own) and total[g].tolist() == [sum(map(int, x)) for x in zip(*own, strict=True)]
    assert not count[7:].any()


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert sorted(map(tuple, clusters.op13_clusters(spark, sf).select(*cols.split(", ")).collect())) == sorted(con.execute(f"select {cols} from ({clusters.ORACLE})").fetchall())
