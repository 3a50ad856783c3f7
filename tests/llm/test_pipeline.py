import re

import pytest

import corpus_pipeline as cp
from tidalbook.llm import bpe, common

from .test_near_dups import brute as near_brute
from .test_repeats import brute as repeat_brute

STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows after each stage."""
    out = [common.table(spark, sf, "documents")]
    for name, stage in cp.STAGES:
        out.append(common.written(stage(spark, out[-1], sf), name))
    return out


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixture", "bpe"]
    assert all(sorted(s.dtypes) == sorted(steps[0].dtypes) for s in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    docs = common.table(spark, sf, "documents")
    before, after = text_of(docs), text_of(cp.toxic(spark, docs, sf))
    assert all(after[i] == before[i] for i in after)
    clean, bad = ([i for i in before if labels.get(i) == y] for y in (0, 1))
    assert sum(i in after for i in clean) >= 0.97 * len(clean) and sum(i not in after for i in bad) >= 0.5 * len(bad)


def test_one_of_each_group_stays(steps):
    before, after = text_of(steps[1]), text_of(steps[2])
    classes = near_brute(list(before.items()), 5, 80)
    assert set(after) == {i for i, _, root in classes if i == root}


def test_repeats_go(steps):
    before, after = text_of(steps[2]), text_of(steps[3])
    assert before.keys() == after.keys()
    removed = {i: n for i, _, n, _, _ in repeat_brute(list(before.items()))}
    for i, t in before.items():
        lost = len(t.encode()) - len(after[i].encode())
        assert removed[i] <= lost <= removed[i] + 8 * (removed[i] > 0) * (1 + t.count("\n"))
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_mix_follows_the_weights(steps):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = {}, {}
    for d, s in ((before, steps[3]), (after, steps[4])):
        for r in s.collect():
            d[r["source"]] = d.get(r["source"], 0) + size(r["text"])
    longest = max(size(r["text"]) for r in steps[3].collect())
    order = sorted(before)
    share = {s: sum(before.values()) * (i % 3 + 1) / sum(j % 3 + 1 for j in range(len(order))) for i, s in enumerate(order)}
    assert all(abs(after.get(s, 0) - min(share[s], 3 * before[s])) <= 2 * longest + 0.1 * share[s] for s in order)


def test_tokens_decode(steps):
    codec = bpe.codec(bpe.default_path())
    mixed = text_of(steps[4])
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(codec.decode(r["ids"]).decode() == mixed[r["doc_id"]] for r in rows)


def test_run_is_the_stages(spark, sf, steps):
    cols = ["doc_id", "ids_sha256"]
    assert sorted(map(tuple, cp.run(spark, sf).select(cols).collect())) == sorted(map(tuple, steps[5].select(cols).collect()))


def test_odd_rows_pass_every_stage(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in cp.STAGES:
            docs = common.written(stage(spark, docs, sf), f"odd-{name}")
        assert "ids" in docs.columns


def test_null_rows_are_not_lost(spark, sf, odd):
    kept = cp.near_duplicates(spark, odd, sf).collect()
    assert sum(r["doc_id"] is None for r in kept) == 1 and {r["doc_id"] for r in kept} >= {None, 1, 3, 4, 5, 14}
    left = {r["doc_id"]: r["text"] for r in cp.repeated_passages(spark, odd, sf).collect()}
    assert left[3] is None and left[4] == "" and left[13] == ""


def test_rows_of_one_id_go_by_their_own_texts(spark, sf):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, "y " + b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"][:2]) for r in cp.near_duplicates(spark, df, sf).collect())
    assert got == [(1, "a0"), (2, "b0"), (2, "b0")]


def test_only_stage_tables_are_removed(spark, sf, tmp_path):
    """A run leaves its input alone and the table that its result is read from."""
    source = str(tmp_path / "in")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(40).write.parquet(f"{source}/{name}.parquet")
    result = cp.run(spark, source)
    n = result.count()
    assert n > 0 and spark.read.parquet(f"{source}/documents.parquet").count() == 40 and result.count() == n
