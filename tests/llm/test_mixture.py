import re

import pytest
from pyspark.sql import functions as F

from tidalbook.llm import mixture


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """By source in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        rest = left - sum(fixed.values())
        over = [s for s in free if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * weight[s] / total for s in free}}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def check(df, **more):
    got = mixture.mix(df, **more).collect()
    want = sorted((str(r["doc_id"]), n_words(r["text"])) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == want
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    goal = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(goal[s]) and taken[s] == int(goal[s] + 1e-9)
        assert {r["source_size"] for r in got if r["source"] == s} == {sizes[s]}
        # whole epochs for all, then at most one document is cut
        parts = [r["taken"] - r["size"] * (taken[s] // sizes[s]) for r in got if r["source"] == s and sizes[s]]
        own = [r["size"] for r in got if r["source"] == s and sizes[s]]
        assert sum(0 < p < n for p, n in zip(parts, own, strict=True)) <= 1


@pytest.mark.parametrize("rows", [5_000, 7])
def test_documents(docs, rows):
    check(docs, rows=rows)


def test_odd_rows(odd):
    check(odd)


def test_small_sources_stop_at_three_epochs(spark):
    rows = [(i, "w " * 50, "b") for i in range(40)] + [(100 + i, "x y z", "c") for i in range(3)] + [(200, None, "a"), (201, "one two", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df)
    assert {r["taken"] for r in mixture.mix(df).where("source = 'c'").collect()} == {9}


def test_reruns_agree_whatever_the_partitions(docs):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    a = sorted(map(tuple, mixture.mix(docs).select(cols).collect()))
    assert a == sorted(map(tuple, mixture.mix(docs.repartition(7)).select(cols).collect()))


def test_empty_table(nothing):
    assert mixture.mix(nothing).count() == 0 and mixture.mixed(nothing).count() == 0


def test_mixed_repeats_rows(docs):
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixture.mix(docs).where("taken > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixture.mixed(docs).groupBy("doc_id").count().collect()}
    assert got == taken and mixture.mixed(docs).columns == docs.columns


def test_mixed_keeps_the_budget_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LOT", 7)
    rows = [(None, "w " * 4, "a", i) for i in range(25)] + [(i, "x y", "b", 0) for i in range(30)] + [(7, "u v w", "c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(6)
    taken = {}
    for r in mixture.mix(df).collect():
        taken.setdefault(r["source"], []).append((r["taken"], r["size"]))
    got = {r["source"]: r["count"] for r in mixture.mixed(df).groupBy("source").count().collect()}
    for s, own in taken.items():
        copies = sum(-(-t // n) for t, n in own)
        assert got[s] == copies and abs(sum(t for t, _ in own) - got[s] * own[0][1]) < own[0][1]
    assert {r["count"] for r in mixture.mixed(df).where("source = 'c'").groupBy("size").count().collect()} <= {1, 2}


def test_targets():
    assert mixture.targets([], []) == [] and mixture.targets([0], [1]) == [0.0]
    assert mixture.targets([10, 10], [1, 3]) == [5.0, 15.0]
    assert mixture.targets([100, 1], [1, 1]) == [98.0, 3.0]


def test_words(spark):
    texts = [None, "", " \t\n", "a", " a b\x0bc\x0cd\re ", "a\xa0b", "日本 語"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), mixture.n_words("t").alias("n"))
    assert all(r["n"] == n_words(r["t"]) for r in df.collect())
