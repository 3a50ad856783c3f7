import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidalbook.llm import fingerprints as fp


def brute(rows):
    """Edited texts by doc_id, nulls first, and by the texts' hashes within one."""
    mark = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() >> 1
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        c = len(t) // 4
        edited = t[: len(t) - c] + rows[(k + 1) % len(rows)][1][:c]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, rows[(k + 1) % len(rows)][1]))
    return out


def alone(text):
    return fp.prints([text.encode()])


def agree(df, rows):
    got = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]))
    want = sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert len(got) == len(want)
    for g, (i, n, sha, t, edited, after) in zip(got, want, strict=True):
        assert (g["doc_id"], g["n_chars"], g["edited_sha256"]) == (i, n, sha)
        a, b, c = alone(t), alone(edited), alone(after)
        assert g["fingerprint"] == fp.to_hex(a[0][0], a[1][0]) and g["edited_fingerprint"] == fp.to_hex(b[0][0], b[1][0])
        assert abs(g["near_edited"] - fp.likeness(a, b)[0]) < 1e-9 and abs(g["near_next"] - fp.likeness(a, c)[0]) < 1e-9


def test_against_brute_force(docs, texts):
    agree(fp.compared(docs), list(texts.items()))


def test_odd_rows(odd):
    agree(fp.compared(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty_table_and_single_row(nothing, odd):
    assert fp.compared(nothing).count() == 0
    one = odd.where("doc_id = 1")
    agree(fp.compared(one), [(r["doc_id"], r["text"]) for r in one.collect()])


@pytest.mark.parametrize("hot", [None, 7])
def test_a_third_of_all_rows_share_an_id_or_have_none(spark, hot):
    """They are dealt over their ranges; no range has more than a few per cent of the rows."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9)))
    rows = [(hot if i % 3 == 0 else i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    agree(fp.compared(df), rows)
    per = fp.with_next(df).where("tail = 0").groupBy("range").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert per[0] < 0.12 * 900 and per[1] == 900 and per[2] >= 14
    same = [(1, "one text")] * 40 + [(2, None)] * 3
    agree(fp.compared(spark.createDataFrame(same, "doc_id long, text string")), same)


def test_algebra():
    a, b, both, turned = ("x y z\nu v w", "p q r", "x y z\nu v w\np q r", "p q r\nu v w\nx y z")
    hexed = lambda t: fp.to_hex(*(x[0] for x in alone(t)))
    assert hexed(both) == hexed(turned) == fp.added(hexed(a), hexed(b)) != hexed(a)
    assert fp.removed(hexed(both), hexed(b)) == hexed(a)
    assert set(hexed("")) == {"0"} and fp.likeness(alone(""), alone(""))[0] == 1.0 and fp.likeness(alone(""), alone("a"))[0] == 0.0


def test_likeness_tells_edits_from_strangers(docs):
    rows = fp.compared(docs).where("n_chars > 800").toPandas()
    assert rows.near_edited.median() > 0.65 and rows.near_next.median() < 0.15


def test_column(docs, texts):
    for r in fp.fingerprint(docs.select("doc_id", "text")).limit(20).collect():
        assert r["fingerprint"] == fp.to_hex(*(x[0] for x in alone(texts[r["doc_id"]])))


def test_lanes_do_not_wrap():
    """A paragraph 40,000 and 20,000 times: the lanes point the same way."""
    assert fp.likeness(alone("a b c\n" * 40_000), alone("a b c\n" * 20_000))[0] > 0.999
    assert fp.likeness(alone("x y z\n" * 40_000), alone("a b c\n" * 20_000))[0] < 0.3


def test_texts_without_spaces():
    rng = random.Random(1)
    a, b = ("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000)) for _ in range(2))
    edited = a[:1500] + b[:500]
    assert 0.6 < fp.likeness(alone(a), alone(edited))[0] < 0.9 and fp.likeness(alone(a), alone(b))[0] < 0.2
    hexed = lambda t: fp.to_hex(*(x[0] for x in alone(t)))
    assert fp.added(hexed(a), hexed(b)) == hexed(a + "\n" + b) == hexed(b + "\n" + a)


def test_a_clashing_column_is_replaced(odd):
    df = odd.withColumnRenamed("lang", "Fingerprint").withColumnRenamed("kept", "a.b")
    got = fp.fingerprint(df).collect()
    assert set(got[0].asDict()) == {*df.columns, "fingerprint"} - {"Fingerprint"} and len(got) == odd.count()
    assert all(r["fingerprint"] == fp.to_hex(*(x[0] for x in alone(r["text"] or ""))) for r in got)
