import hashlib
import math
import random

import numpy as np
import pytest

from tidalbook.llm import codes, whole

KIND = "vec_id long, embedding array<double>, label int, code string, v string"


def brute(rows, parts, entries, rounds, by, dims):
    kept = [(i, [math.floor(by * x) for x in e], y) for i, e, y in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    fit = [r for r in kept if len(r[1]) == dims]
    w = dims // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in fit]
    first = sorted(range(len(fit)), key=lambda j: (fit[j][0] is None, fit[j][0] or 0, fit[j][1]))[:entries]
    books = [[cut[j][p] for j in first] for p in range(parts)]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), n) for n, e in enumerate(books[p])) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            at = near(p)
            for n in range(len(books[p])):
                own = [c[p] for c, (_, m) in zip(cut, at, strict=True) if m == n]
                if own:
                    books[p][n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [near(p) for p in range(parts)]
    errors = [sum(final[p][j][0] for p in range(parts)) for j in range(len(fit))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    per, top = {}, whole.MOST
    for (_, _, y), e in zip(fit, errors, strict=True):
        per[y] = per.get(y, 0) + min(e, top)
    out = [(i, "".join(f"{final[p][j][1]:02x}" for p in range(parts)), min(errors[j], top), min(per[y], top), sha) for j, (i, _, y) in enumerate(fit)]
    out += [(i, None, None, None, sha) for i, v, _ in kept if len(v) != dims]
    return sorted(out, key=str)


def run(spark, rows, parts=2, entries=6, rounds=3, by=16):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    made = codes.codes(df, "vec_id", "embedding", "label", by, parts, entries, rounds)
    return sorted(map(tuple, made.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("kind", ["random", "ties", "clumps"])
def test_against_full_scans(spark, kind):
    rng = random.Random(3)
    make = {"random": lambda i: [rng.uniform(-2, 2) for _ in range(16)], "ties": lambda i: [float(rng.randrange(2)) for _ in range(16)], "clumps": lambda i: [10.0 * (i % 9) + rng.random()] * 16}[kind]
    rows = [(i, make(i), [None, 1, 2][i % 3]) for i in range(200)]
    assert run(spark, rows) == brute(rows, 2, 6, 3, 16, 16)


def test_odd_rows(spark):
    bad = [(0, None, 1), (1, [], 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], None), (4, [1.0, float("inf")], 2)]
    odd = [(5, [1.0, 2.0, 3.0], 1), (6, [1.0, 2.0, 3.0, 4.0], None)]  # a length that parts don't divide, and another length
    good = [(5, [0.1, -0.1], None), (5, [0.1, -0.1], None), (None, [3.0, 4.0], 7), (9, [-1.0, 0.0], 7), (8, [0.2, 0.3], None)]
    assert run(spark, bad + odd[:1] + good) == brute(bad + odd[:1] + good, 2, 6, 3, 16, 2)
    assert run(spark, bad + odd + good) == brute(bad + odd + good, 2, 6, 3, 16, 2)


def test_nothing_to_code(spark):
    assert run(spark, []) == [] == run(spark, [(1, None, 1)])
    assert run(spark, [(1, [1.0], 1)]) == [(1, None, None, None, None)]  # no vector can be cut


@pytest.mark.parametrize("size", [1e9, 1e17, 1e30, 1e150, 1e300])
def test_numbers_of_any_size(spark, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size), float(i), 0.5, -size], i % 2) for i in range(40)]
    assert run(spark, rows) == brute(rows, 2, 6, 3, 16, 4)


def test_bounds_filter_and_lose_nothing():
    rng = np.random.default_rng(2)
    around = rng.integers(-900, 900, size=(40, 1)) + np.cumsum(rng.integers(-60, 60, size=(40, 16)), axis=1)
    x = np.floor(around[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 30).astype(float)
    book = codes.Codebook(np.concatenate((x[:200], x[:56])))  # with repeated entries
    index, distance, exact = book.nearest(x)
    every = ((x[:, None] - book.entries) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < every.size / 4  # coarse levels leave few entries for exact distances
    assert codes.Codebook(x[:1]).nearest(x[:5])[0].tolist() == [0] * 5
    assert [len(a) for a in book.nearest(x[:0])[:2]] == [0, 0]


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cols = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(map(tuple, codes.op11_codes(spark, sf).select(*cols.split(", ")).collect())) == sorted(con.execute(f"select {cols} from ({codes.ORACLE})").fetchall())
