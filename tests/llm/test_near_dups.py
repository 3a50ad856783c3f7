import random
import re

import numpy as np
import pytest

from tidalbook.llm import components, near_dups

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=3, parts=85):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= parts * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def result(df, **more):
    return near_dups.classes(df, **more).collect()


def check(df, rows, **more):
    got = result(df, **more)
    named = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert named == brute(rows, more.get("words", 3), more.get("parts", 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert len(got) == df.count()


def test_against_brute_force(docs, texts):
    check(docs, list(texts.items()))


def test_five_words_and_a_lower_threshold(docs, texts):
    check(docs, list(texts.items()), words=5, parts=80, bands=28)


def test_odd_rows(odd):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty_table(nothing):
    assert result(nothing) == []


def test_chains_and_crowds(spark):
    """A chain of small edits, a crowd of copies of one text with an edit each, and a template that none of its fillings share enough of."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows, words = [], list(base)
    for i in range(25):
        words[rng.randrange(200)] = f"c{i}"
        rows.append((i, " ".join(words)))
    for i in range(100, 180):
        w = [f"d{j}" for j in range(150)]
        for _ in range(4):
            w[rng.randrange(150)] = f"e{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):
        rows.append((i, " ".join([*(f"t{j}" for j in range(80)), *(f"f{i}x{j}" for j in range(15))])))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    rows = [(i, " ".join([*(f"t{j}" for j in range(60)), *(f"f{i // 2}x{j}" for j in range(12)), f"g{i}"])) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("more", [{"words": 3, "parts": 85}, {"words": 5, "parts": 80, "bands": 28}])
def test_short_pairs(spark, more):
    """Texts of 5 to 50 shingles and the same with words added, at the threshold or just above and just below it."""
    n, parts, rows = more["words"], more["parts"], []
    for size in [5, 6, 8, 10, 12, 17, 25, 40, 50]:
        for least in (0, 1):
            longer = -(-100 * size // parts) - 1 + least + (least == 0 and size % 2) * 2
            for _ in range(25):
                i = len(rows)
                text = [f"p{i}w{j}" for j in range(longer + n - 1)]
                rows += [(i, " ".join(text[: size + n - 1])), (i + 1, " ".join(text))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, **more)


def test_two_texts_under_one_id(spark):
    """Both texts' links are found, whichever row comes first."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a + " z"), (5, "other words")]
    for turn in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in result(spark.createDataFrame(turn, "doc_id long, text string"))}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_crowds_around_a_middle(spark, monkeypatch):
    """Copies of one text with edits of different sizes: most join the middle, the far ones only each other, or nothing."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rng, rows = random.Random(13), []
    base = [f"b{j}" for j in range(90)]
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            words[rng.randrange(90)] = f"e{i if i % 7 else 0}x{rng.randrange(3)}"
        rows.append((500 - i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_short_texts_of_large_buckets(spark):
    """Short texts of one template, in pairs that are linked among themselves only."""
    rows = [(i, " ".join([*(f"t{j}" for j in range(12)), *(f"f{i // 2}x{j}" for j in range(8)), *(["more"] if i % 2 else [])])) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_no_short_pair_is_ruled_out():
    rng = np.random.default_rng(2)
    for a, b, buckets, parts in ((6, 7, 80, 85), (12, 14, 80, 85), (34, 40, 80, 85), (4, 5, 112, 80), (8, 10, 112, 80), (40, 50, 112, 80)):
        items = [rng.integers(0, 2**64, b, np.uint64) for _ in range(2000)]
        x, y = near_dups.registers([i[:a] for i in items], buckets), near_dups.registers(items, buckets)
        assert near_dups.may_reach(x, y, np.full(2000, a), np.full(2000, b), parts, 100).all()
        others = near_dups.registers([rng.integers(0, 2**64, b, np.uint64) for _ in items], buckets)
        assert not near_dups.may_reach(x, others, np.full(2000, a), np.full(2000, b), parts, 100).any()


@pytest.mark.parametrize("jaccard", [0.3, 0.85])
def test_estimate(jaccard):
    rng = np.random.default_rng(1)
    n = 2000
    shared = int(2 * n * jaccard / (1 + jaccard))
    got = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = near_dups.registers([np.unique(x[:n]), np.unique(x[n - shared :])], 128)
        got.append(near_dups.estimate(a[None], b[None], np.array([n]), np.array([n]))[0])
    assert abs(np.mean(got) - jaccard) < 0.04


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
