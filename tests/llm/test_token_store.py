import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalbook.llm import bpe, token_store


def stored(df, path, **more):
    cuts = token_store.write(df, path, end=2, **more)
    counts = df.groupBy("doc_id").count()
    keys = counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("nth"))
    return token_store.lookup(keys, path, cuts)


def expected(rows):
    codec = bpe.codec(bpe.default_path())
    coded = [(i, np.append(np.frombuffer(codec.blobs([t or ""])[0], "<u4"), 2).astype("<u4")) for i, t in rows]
    out, start = [], 0
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents(docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 3000)  # several shards to a range
    got = sorted(map(tuple, stored(docs, str(tmp_path / "s")).collect()))
    assert got == expected(texts.items())


def test_odd_rows(odd, tmp_path):
    got = [tuple(r) for r in stored(odd, str(tmp_path / "s")).collect()]
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == want


def test_empty_table_and_unknown_keys(spark, odd, nothing, tmp_path):
    assert stored(nothing, str(tmp_path / "n")).count() == 0
    one = odd.where("doc_id < 8")
    cuts = token_store.write(one, str(tmp_path / "s"), end=2)
    asked = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (2, 2), (99, 0), (None, 0)], "doc_id long, nth long")
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in token_store.lookup(asked, str(tmp_path / "s"), cuts).collect()) == [(1, True), (2, True), (2, True)]


def test_index_is_perfect_and_rejects_strangers():
    for n in (1, 2, 3, 10, 1000):
        keys = token_store.key_hashes(list(range(n)), [0] * n)
        seeds, slots = token_store.build_index(keys)
        assert sorted(slots) == list(range(n)) and (token_store.find(keys, seeds, n) == slots).all()
        marks = np.empty(n, np.uint32)
        marks[slots] = token_store.prints(keys)
        strange = token_store.key_hashes(list(range(10**6, 10**6 + 2000)), [0] * 2000)
        assert (marks[token_store.find(strange, seeds, n)] == token_store.prints(strange)).sum() == 0


def test_index_of_colliding_and_many_keys():
    for n in (4097, 30_000):
        keys = token_store.key_hashes([None, *range(n - 1)], [0] * n)
        seeds, slots = token_store.build_index(keys)
        assert (np.sort(slots) == np.arange(n)).all() and (token_store.find(keys, seeds, n) == slots).all()


def test_single_documents_by_offset(docs, texts, tmp_path):
    """One key costs the index and the document's own bytes."""
    cuts = token_store.write(docs, str(tmp_path / "s"), end=2)
    codec, folder = bpe.codec(bpe.default_path()), f"{tmp_path}/s/ids"
    names = docs.sparkSession.read.schema(token_store.SHARD).parquet(f"{tmp_path}/s/shards").collect()
    assert len(names) > 1 and len(cuts.cuts) > 1 and sum(r["n_docs"] for r in names) == len(texts)
    for i in list(texts)[::37]:
        r = next(r for r in names if r["first_id"] <= i <= r["last_id"])
        shard = token_store.Shard(folder, r["name"])
        want = [*np.frombuffer(codec.blobs([texts[i] or ""])[0], "<u4"), 2]
        read, file = [], shard.file
        shard.file = type("Counted", (), {"read_at": staticmethod(lambda n, at, f=file, r=read: r.append(n) or f.read_at(n, at)), "close": file.close})
        assert shard.get(i).tolist() == want and shard.get(-7) is None and read == [2 * len(want)]
        shard.close()


def test_one_hot_id_and_rows_without_any(spark, tmp_path):
    """A third of the rows have no id, a third share one: both lie in several ranges, and every row is found."""
    rows = [(None, f"text {i % 40} of none") for i in range(200)] + [(7, f"text {i} of seven") for i in range(200)] + [(i, f"own text {i}") for i in range(-100, 100) if i != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = token_store.write(df, str(tmp_path / "s"), end=2)
    assert set(made.several) == {token_store.LOW, 7} and all(len(r) > 1 for r, _ in made.several.values())
    shards = spark.read.parquet(f"{tmp_path}/s/shards").collect()
    assert max(r["n_docs"] for r in shards) < 150
    counts = df.groupBy("doc_id").count()
    keys = counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("nth"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.lookup(keys, str(tmp_path / "s"), made).collect())
    assert [g[1] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    codec = bpe.codec(bpe.default_path())
    crc = lambda t: zlib.crc32(np.append(np.frombuffer(codec.blobs([t])[0], "<u4"), 2).astype("<u4").tobytes())
    assert sorted((str(g[1]), g[3]) for g in got) == sorted((str(i), crc(t)) for i, t in rows)


def test_query(spark, sf, texts):
    assert sorted(map(tuple, token_store.op6_token_store(spark, sf).collect())) == expected(texts.items())


def test_keys_of_hot_ids_are_numbered_by_lots(spark, monkeypatch):
    monkeypatch.setattr(token_store, "LOT", 4)
    ids = [7] * 13 + [8] * 4 + [None] * 5 + [9]
    got = sorted(((r["doc_id"] or 0, r["nth"]) for r in token_store.numbered(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()))
    assert got == sorted((i or 0, n) for i in set(ids) for n in range(ids.count(i)))


def test_stores_by_their_names(tmp_path):
    """Spark's names of S3 are Arrow's; what Arrow does not know fails with a clear message."""
    for name in ("s3", "s3a", "s3n"):
        fs, path = token_store.store(f"{name}://bucket/a/b?region=eu-west-1")
        assert fs.type_name == "s3" and path == "bucket/a/b"
    for local in (f"file://{tmp_path}", f"file:{tmp_path}", str(tmp_path)):
        fs, path = token_store.store(local)
        assert fs.type_name == "local" and path == str(tmp_path)
    with pytest.raises(ValueError, match="dbfs"):
        token_store.store("dbfs:/somewhere")
