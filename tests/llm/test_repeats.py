import datetime as dt
import hashlib
import random
import time
from decimal import Decimal

import numpy as np
import pytest
import zstandard

from tidalbook.llm import repeats
from tidalbook.llm.run_index import RunIndex


def brute(rows):
    """(doc_id, bytes, removed, spans, hash) by looking up every 50-byte string."""
    last = float("inf")
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (last if i is None else i):
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def check(df, rows):
    assert sorted((tuple(r) for r in repeats.without_repeats(df).select(COLS).collect()), key=str) == brute(rows)


def test_documents(docs, texts):
    check(docs, list(texts.items()))


def test_odd_rows(odd):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty_table(nothing):
    assert repeats.without_repeats(nothing).count() == 0


def test_edges(spark):
    """Matches of 49, 50 and 51 bytes, over the text's ends, inside one document, nested and overlapping, and cut characters."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = word(300), word(300)
    rows = [(10, p), (20, q), (5, p[:49] + "#" + q[100:150]), (30, "#" + p[20:70] + "#" + p[20:71]), (40, p[:60] + p[30:120]), (50, q + q), (60, q[5:54]), (70, p[250:] + q[:60]), (80, "é" * 60), (90, "xé" + "é" * 40)]
    rows += [(100 + i, word(rng.randrange(30)) + p[i : i + rng.randrange(40, 90)] + word(20)) for i in range(60)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_one_letter(spark):
    rows = [(i, "z" * (45 + 3 * i)) for i in range(12)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_carried_columns(odd):
    got = repeats.without_repeats(odd, carry=("source", "range", "band")).select("doc_id", "source", "range", "band").collect()
    assert sorted(map(str, got)) == sorted(map(str, odd.select("doc_id", "source", "range", "band").collect()))


def test_carried_columns_keep_their_values(spark):
    """Microseconds, bytes, decimals, nested and null values; and the order of rows with one id and text."""
    at = dt.datetime(2024, 5, 6, 7, 8, 5, 123456)
    text = "some words that stand in two documents of this little table, and are long enough"
    rows = [(i % 3 if i < 9 else None, text if i % 2 else "other " + text, at + dt.timedelta(microseconds=i), bytes([i, 255]), Decimal(i) / 8, [{"k.x": float(i)}], {"a": i} if i % 4 else None, None) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t timestamp, raw binary, money decimal(20,6), deep array<map<string,double>>, m map<string,int>, none string")
    carry = ("t", "raw", "money", "deep", "m", "none")
    got = repeats.without_repeats(df, carry=carry).select("doc_id", *carry).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.select("doc_id", *carry).collect()))


def test_whole_characters(spark):
    """No lead byte before a removed run meets a trailing byte behind it; text that is left stays text."""
    p = "".join(chr(0xE0 + i % 30) for i in range(40))
    rows = [(1, "x" * 3 + p), (2, "é" + p[1:38] + "è" + p), (3, "日" + p), (4, p[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: r for r in repeats.without_repeats(df).collect()}
    for r in repeats.without_repeats(df, characters=True).collect():
        text, kept = dict(rows)[r["doc_id"]], iter(r["kept"])
        it = iter(text)
        assert all(c in it for c in kept) and len(r["kept"].encode()) <= len(removed[r["doc_id"]]["kept"])
        assert (r["n_removed"], r["kept_sha256"]) == (removed[r["doc_id"]]["n_removed"], removed[r["doc_id"]]["kept_sha256"])


@pytest.mark.parametrize("fan", [2, 5])
def test_segments_of_many_blocks_meet_in_lots(spark, docs, texts, monkeypatch, fan):
    """64 blocks in lots of ``fan``: several levels, the same rows."""
    monkeypatch.setattr(repeats, "FAN", fan)
    some = dict(list(texts.items())[:120])
    check(docs.where(docs.doc_id.isin(list(some))), list(some.items()))


def test_run_index_of_two_short_strings():
    """Fewer characters than the second place that a round looks at."""
    a, b = b"x" * 30 + b"abcdefghijklmnopqrstuvwxyz0123", b"y" + b"x" * 29 + b"abcdefghijklmnopqrstuvwxyz01"
    index = RunIndex(np.frombuffer(a + b, np.uint8), np.array([len(a), len(b)]), np.array([7, 3]), 50)
    first = {}
    for t, owner in ((a, 7), (b, 3)):
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], owner), owner)
    assert index.smallest_owners().tolist() == [first[t[s : s + 50]] for t in (a, b) for s in range(len(t) - 49)]


def test_blocks_and_buckets_exchange_few_rows(spark, monkeypatch):
    """10 GB of text: fewer than two thousand rows a block, though blocks and buckets both follow the text."""
    seen = []
    monkeypatch.setattr(repeats.common, "written", lambda df, what="": df)
    monkeypatch.setattr(repeats, "owners", lambda blocks, shared, n_anchors, n, n_blocks: seen.append((n_anchors, n, n_blocks)) or shared.withColumnsRenamed({"shared": "counts", "hot": "low"}))
    repeats.without_repeats(spark.range(2_000).selectExpr("id as doc_id", "repeat('x', 5000000) as text"))
    [(n_anchors, n, n_blocks)] = seen
    assert n_blocks > 4_000 and n_anchors > 200 and n > 1_000 and n_anchors + n < 2_000


@pytest.mark.parametrize("n", [4_000, 40_000])
def test_indexes_stay_small(monkeypatch, n):
    """However many segments meet in a bucket, an index holds about ``SEGMENTS`` bytes of them; the smallest ids are those of all."""
    largest = []

    class Seen(RunIndex):
        def __init__(self, data, *rest):
            largest.append(len(data))
            super().__init__(data, *rest)

    monkeypatch.setattr(repeats, "RunIndex", Seen)
    rng = np.random.default_rng(3)
    words = rng.integers(97, 123, (n // 4, 70), dtype=np.uint8)
    which, cut = rng.integers(0, n // 4, n), rng.integers(0, 15, n)  # a passage's segments begin at some place in it
    count = 21 - cut
    data = np.concatenate([words[w, c : c + k + 49] for w, c, k in zip(which, cut, count, strict=True)])
    low, mark = rng.integers(0, 1_000, n), which.astype(np.uint32)
    first = {}
    texts = [bytes(x) for x in np.split(data, np.cumsum(count + 49)[:-1])]
    for t, o in zip(texts, low.tolist(), strict=True):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], o), o)
    assert repeats.smallest(data, count, low, mark).tolist() == [first[t[i : i + 50]] for t in texts for i in range(len(t) - 49)]
    assert max(largest) < 200_000


def test_rows_of_a_block_cost_nothing_each():
    """A block's segments take as long to send to 7,680 buckets as to 125."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes() for _ in range(100)]
    rows = {"carried": [b""], "ids": [repeats._pack(np.arange(100))], "nulls": [repeats._pack(np.zeros(100, np.uint8))], "sizes": [repeats._pack(np.full(100, 20_000))], "texts": [zstandard.ZstdCompressor().compress(b"".join(texts))]}
    b = repeats.Block(rows)
    b.hot = np.zeros(len(b.first), bool)
    took = {}
    for n in (125, 7_680, 125, 7_680):
        start = time.process_time()
        first, bucket, _ = repeats.distinct_segments(b, n)
        buckets, ends = repeats.runs(bucket)
        size = b.count[first] + repeats.DEPTH - 1
        sent = repeats._cut(repeats.slices(b.data, b.first[first], size), np.concatenate(([0], np.cumsum(size)))[ends])
        data, sizes = repeats._joined(sent, np.uint8)
        took[n] = min(took.get(n, 9.0), time.process_time() - start)
        assert len(sent) == len(buckets) <= n and len(data) == size.sum() == sizes.sum()
    assert took[7_680] < 1.5 * took[125] + 0.05


@pytest.mark.parametrize("three", [0, 1 << 21])
@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_run_index(letters, three, monkeypatch):
    monkeypatch.setattr(RunIndex, "THREE", three)
    rng = random.Random(9)
    base = "".join(rng.choice(letters) for _ in range(900)).encode()
    segments = set()
    while len(segments) < 150:
        i, n = rng.randrange(800), rng.randrange(50, 81)
        s = bytearray(base[i : i + n])
        if rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.randrange(256)
        segments.add(bytes(s))
    segments = sorted(segments, key=lambda s: rng.random())
    owners = np.array([rng.randrange(1000) for _ in segments])
    first = {}
    for s, o in zip(segments, owners.tolist(), strict=True):
        for i in range(len(s) - 49):
            first[s[i : i + 50]] = min(first.get(s[i : i + 50], 10**9), o)
    index = RunIndex(np.frombuffer(b"".join(segments), np.uint8), np.array(list(map(len, segments))), owners, 50)
    assert index.smallest_owners().tolist() == [first[s[i : i + 50]] for s in segments for i in range(len(s) - 49)]
    assert len(index.start) <= sum(map(len, segments)) + len(segments)


def test_run_index_of_segments_that_end_alike():
    rng = random.Random(1)
    for _ in range(300):
        base = bytes(rng.randrange(97, 97 + rng.randrange(1, 5)) for _ in range(120))
        segments = list({base[i : i + rng.randrange(50, 81)] for i in (rng.randrange(40) for _ in range(4))} | {base[-54:], base[-50:]})
        owners = np.array([rng.randrange(9) for _ in segments])
        first = {}
        for s, o in zip(segments, owners.tolist(), strict=True):
            for i in range(len(s) - 49):
                first[s[i : i + 50]] = min(first.get(s[i : i + 50], 99), o)
        index = RunIndex(np.frombuffer(b"".join(segments), np.uint8), np.array(list(map(len, segments))), owners, 50)
        assert index.smallest_owners().tolist() == [first[s[i : i + 50]] for s in segments for i in range(len(s) - 49)]
