import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidalbook.llm import bpe, token_store

ODD = [
    "", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "a" * 3000, "aaaa aaa  aa\n\n\n b '' 's don't I'LL we'll  ", "²½ x² Ⅷ 12٣", " ՘x ꟒ \U00010940b x՘y",
    "\U0001f600 néé\x00\x85  x", "a\x1c\x1d b\x1fc", " 日本語 テスト" * 50, "\xa0x", "\r\n\t  \t end ", "''''s''t", "x" * 700 + " " + "ab" * 900,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module", params=[bpe.Codec, token_store.LibraryCodec])
def codec(request):
    return request.param(bpe.default_path())


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_odd_texts(codec, library):
    for t, b in zip(ODD, codec.blobs(ODD), strict=True):
        assert ids(b) == library.encode(t, add_special_tokens=False).ids, t
        assert codec.decode(b).decode() == t


def test_documents(codec, library, texts):
    own = list(texts.values())[:60]
    for t, b in zip(own, codec.blobs(own), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(b) == want and codec.decode(b).decode() == library.decode(want, skip_special_tokens=False) == t


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    from tokenizers import Tokenizer

    c, t = bpe.codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    b = c.blobs([text])[0]
    assert ids(b) == t.encode(text, add_special_tokens=False).ids and c.decode(b).decode() == text


def test_small_cache_gives_the_same(texts, monkeypatch):
    monkeypatch.setattr(bpe.Codec, "most", 5)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    own = list(texts.values())[:20]
    assert bpe.Codec(bpe.default_path()).blobs(own) == bpe.codec(bpe.default_path()).blobs(own)


def test_round_trip_of_odd_rows(odd, library):
    rows = bpe.round_trip(odd, keep=("doc_id", "part"), with_ids=True).collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect())
    assert sorted(r["decoded_sha256"] for r in rows) == want
    assert all(r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4 for r in rows)


def test_encode_then_decode(odd, nothing):
    coded = bpe.encode(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in odd.where("doc_id is not null").collect())
    assert bpe.encode(nothing).count() == 0


def test_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in bpe.op4_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys() and all(got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
