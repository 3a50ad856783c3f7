import random

import numpy as np
import pytest

from tidalbook.llm import topk


def brute(rows, is_query, k):
    out = []
    for q, v in rows:
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, is_query="id % 5 = 0", k=4, kind="long"):
    df = spark.createDataFrame(rows, f"id long, v array<{kind}>")
    return sorted(tuple(r) for r in topk.top_k(df.where(is_query), df, k).collect())


@pytest.mark.parametrize("kind", ["random", "ties", "clusters"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "QUERIES", 20)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    rng = random.Random(4)
    make = {"random": lambda i: [rng.randrange(-999, 999) for _ in range(6)], "ties": lambda i: [rng.randrange(0, 2) for _ in range(3)], "clusters": lambda i: [1000 * (i % 4) + rng.randrange(3), 7 * (i % 4), 1]}[kind]
    rows = [(i, make(i)) for i in range(300)]
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 4)


def test_few_rows_lengths_and_repeats(spark):
    rows = [(0, [1, 2]), (1, [1, 2]), (5, [3]), (6, [3, 4])]
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 4)
    assert run(spark, [(0, [1])]) == []
    again = [(0, [1, 1]), (0, [1, 1]), (1, [2, 2])]  # rows of the query's own id are no candidates
    assert set(run(spark, again)) == {(0, 1, 1, 4), (0, 2, 1, 4)}


@pytest.mark.parametrize("block", [4096, 25])
def test_negative_scores_that_tie(spark, monkeypatch, block):
    """Zero radii, scores below minus a million, larger ids in the nearer cell."""
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = [(5, [-3000, 0]), *((i + 6, [1000, -500]) for i in range(60)), *((i + 1006, [1000, 500]) for i in range(60))]
    assert run(spark, rows, "id = 5", 10) == brute(rows, lambda q: q == 5, 10)
    assert run(spark, [*rows[61:], *rows[:61]], "id = 5", 10) == brute(rows, lambda q: q == 5, 10)


def test_scores_beyond_doubles_and_longs(spark):
    big = 1 << 27
    rows = [(0, [big, 1]), (2, [big + 1, 1]), (1, [big + 1, 0])]
    assert run(spark, rows, "id = 0") == [(0, 1, 2, big * (big + 1) + 1), (0, 2, 1, big * (big + 1))]
    huge = [(0, [2.0**40, 0.0]), (1, [2.0**40, 5.0]), (2, [2.0**41, 0.0]), (3, [-(2.0**40), 0.0]), (4, [1.0, 0.0]), (6, [1e200, 0.0])]
    got = run(spark, huge, "id = 0", 9, "double")
    assert got == [(0, 1, 1, topk.MOST), (0, 2, 2, topk.MOST), (0, 3, 6, topk.MOST), (0, 4, 4, 1 << 40), (0, 5, 3, -topk.MOST)]


def test_groups_and_blocks_are_pruned(spark, monkeypatch):
    """Far cells lie below a group's first k-th scores, so few pairs of groups and blocks are left."""
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = random.Random(5)
    rows = [(i, [10_000 * ((i % 8) == j) + rng.randrange(9) for j in range(8)]) for i in range(800)]
    seen = []
    written = topk.common.written
    monkeypatch.setattr(topk.common, "written", lambda df, what: seen.append((what, written(df, what))) or seen[-1][1])
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 4)
    tables = dict(seen)
    every = tables["topk-queries"].count() * tables["topk-data"].count()
    assert every >= 64 and tables["topk-pairs"].count() <= every / 4


def test_a_sample_that_finds_nothing(spark, monkeypatch):
    """Few vectors, each many times: hashes may all lie above the sample's."""
    monkeypatch.setattr(topk, "SAMPLE", 0)
    rows = [(i % 3, [i % 3, 1]) for i in range(60)] + [(7, [2])]
    assert run(spark, rows, "id = 0", 100) == [(0, n + 1, 1 + (n >= 400), 1) for n in range(800)][:100]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, v array<long>")
    assert topk.top_k(df, df, 3).count() == 0


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [0.5, -0.0001]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, []), (None, [1.0, 1.0]), (600, [2.0, 3.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(map(tuple, topk.scaled(df, "vec_id", "embedding", 1024).collect())) == [(0, [512, -1]), (600, [2048, 3072])]


def test_tree_covers_its_points():
    pts = np.random.default_rng(0).normal(size=(500, 5))
    t = topk.CoverTree(pts, leaf=10)
    seen = []

    def walk(v):
        own = list(t.members[v]) if t.members[v] is not None else [x for c in t.children[v] for x in walk(c)]
        assert max(np.linalg.norm(pts[own] - pts[t.centre[v]], axis=1)) <= t.radius[v] + 1e-9
        return own

    seen = walk(t.root)
    assert sorted(seen) == list(range(500))


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cols = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, topk.op2_topk(spark, sf).select(*cols).collect())) == sorted(con.execute(f"select {', '.join(cols)} from ({topk.ORACLE})").fetchall())
