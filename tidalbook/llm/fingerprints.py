"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (text between line feeds) is hashed to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two.  So the order of paragraphs does not matter, and a paragraph is added to
or taken from a fingerprint by adding or subtracting its vector (``added`` and
``removed``), without the text.

The vector has two parts.  ``EXACT`` lanes modulo 2^32 come from a hash of the
whole paragraph: equal sums mean equal multisets of paragraphs.  ``LIKE`` lanes
modulo 2^32 sum a signed unit for each word of the paragraph with its two
followers, so the cosine of two documents' lanes estimates that of their word
triples; the standard error is about ``LIKE ** -0.5``.  No text that fits a row
has units enough to wrap a lane.  Words of ``LONG`` bytes or more, as in texts
without white space, also give a unit for each of their ``GRAM``-byte strings.
``likeness`` is 1 for equal fingerprints, else that cosine, 0 at least.

A null text counts as empty; the empty text has no paragraphs and a fingerprint
of zeros, whose likeness to any other is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_store, words

EXACT, LIKE, LONG, GRAM = 32, 256, 40, 12
#: Characters fingerprinted at a time, and key ranges per shuffle partition.
CHUNK, RANGES = 1_500_000, 4


def like_lanes(texts: list[bytes]) -> np.ndarray:
    """The signed lanes of many texts (n x LIKE, int32), computed together."""
    n = len(texts)
    hashes, start, doc, data = words.word_hashes(texts)
    if not len(start):
        return np.zeros((n, LIKE), np.int32)
    line = np.cumsum(data == 10)[start]  # a word's followers lie in its paragraph
    follow = np.zeros((2, len(hashes)), np.uint64)
    for k in (1, 2):
        same = line[k:] == line[:-k]
        follow[k - 1, :-k][same] = hashes[k:][same]
    with np.errstate(over="ignore"):
        mixed = words.scrambled(hashes * np.uint64(3) + words.scrambled(follow[0] * np.uint64(5) + words.scrambled(follow[1] + np.uint64(7))))
    grams, owner = long_words(data, start, doc)
    mixed, doc = np.concatenate((mixed, grams)), np.concatenate((doc, owner))
    lane = (mixed % np.uint64(LIKE)).astype(np.int64)
    sign = ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    total = np.bincount(doc * LIKE + lane, weights=sign, minlength=n * LIKE).reshape(n, LIKE)
    return (total.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def long_words(data: np.ndarray, start: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``GRAM``-byte strings within words of ``LONG`` bytes or more, and their texts' numbers."""
    maybe = np.flatnonzero(np.diff(np.append(start, len(data))) > LONG)  # the gap to the next word holds white space too
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in maybe.tolist():
        gap = data[start[i] : start[i + 1] if i + 1 < len(start) else len(data)]
        size = int(np.append(np.flatnonzero(words.SPACES[gap]), len(gap))[0])
        if size >= LONG:
            with np.errstate(over="ignore"):
                h = np.zeros(size - GRAM + 1, np.uint64)
                for k in range(GRAM):
                    h = h * np.uint64(0x100000001B3) + gap[k : size - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
            hashes.append(words.scrambled(h))
            owner.append(np.full(len(h), doc[i]))
    return np.concatenate(hashes), np.concatenate(owner)


def exact_lanes(text: bytes) -> np.ndarray:
    if not text:
        return np.zeros(EXACT, "<u4")
    wide = b"".join([hashlib.shake_128(p).digest(4 * EXACT) for p in text.split(b"\n")])
    return np.frombuffer(wide, "<u4").reshape(-1, EXACT).sum(0, dtype=np.uint64).astype("<u4")


def prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprints of many texts."""
    return np.array([exact_lanes(t) for t in texts], "<u4").reshape(len(texts), EXACT), like_lanes(texts)


def to_hex(exact: np.ndarray, like: np.ndarray) -> str:
    return exact.astype("<u4").tobytes().hex() + like.astype("<i4").tobytes().hex()


def parts(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), np.frombuffer(raw[4 * EXACT :], "<i4")


def added(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of ``a`` and ``b`` together, or (sign -1) of ``a`` without those of ``b``."""
    (ea, la), (eb, lb) = parts(a), parts(b)
    exact = (ea.astype(np.int64) + sign * eb.astype(np.int64)) & 0xFFFFFFFF
    like = (la.astype(np.int64) + sign * lb.astype(np.int64)) & 0xFFFFFFFF
    return to_hex(exact.astype("<u4"), like.astype("<u4").view("<i4"))


def removed(a: str, b: str) -> str:
    return added(a, b, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1."""
    equal = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``df`` with one more column, each text's fingerprint; a column of that name is replaced."""

    def make(texts: list) -> pa.Array:
        made: list[str] = []
        for _, group in words.chunks([(x or "").encode() for x in texts], CHUNK):
            made += [to_hex(e, w) for e, w in zip(*prints(group), strict=True)]
        return pa.array(made, pa.string())

    return common.with_made(df, text, into, "string", make)


def range_numbers(keys: np.ndarray, marks: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The range of each row in the order of (key, mark); a key that stands several times among the cuts is parted by its marks, evenly."""
    at = np.array(cuts, np.int64)
    low, high = np.searchsorted(at, keys, side="left"), np.searchsorted(at, keys, side="right")
    within = low + 1 + ((marks >> 20) * (high - low) >> 43)
    return np.where(high - low > 1, within, high).astype(np.int32)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt to ranges of ascending keys, each range followed by the first row of the next (``tail``; the first of all after the last).

    Rows of one key follow each other in the order of a hash of their texts, so
    that a key which fills several ranges (or rows without one, which come
    first) is dealt over them; only rows that are equal in both meet.  The
    driver holds the ranges' cuts and the key and hash that open each.
    """
    n = RANGES * common.n_partitions(df.sparkSession)
    cuts = token_store.ranges(df, n, key)
    mark = F.shiftrightunsigned(F.xxhash64("text"), 1).alias("mark")
    held = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", "text", mark)

    def number(b: pa.RecordBatch) -> dict:
        keys, marks = token_store.keys_of(b.column(0)), b.column(1).to_numpy()
        return {"range": pa.array(range_numbers(keys, marks, cuts)), "key": pa.array(keys), "mark": b.column(1)}

    numbered = common.arrow_map(held.select("doc_id", "mark"), number, "range int, key long, mark long")
    first = sorted(map(tuple, numbered.groupBy("range").agg(F.min(F.struct("key", "mark")).alias("f")).select("range", "f.key", "f.mark").collect()))
    # a range is followed by the row that opens the next range with rows
    opens = {f[1:]: first[i - 1][0] for i, f in enumerate(first)}

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, marks = token_store.keys_of(b.column(0)), b.column(2).to_numpy()
        own = range_numbers(keys, marks, cuts)
        again = [(i, opens[x]) for i, x in enumerate(zip(keys.tolist(), marks.tolist(), strict=True)) if x in opens]
        rows = pa.array([*range(len(keys)), *(i for i, _ in again)], pa.int32())
        part = np.concatenate((own, np.array([r for _, r in again], np.int32)))
        tail = np.concatenate((np.zeros(len(keys), np.int32), np.ones(len(again), np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(tail), *(b.column(i).take(rows) for i in range(3))], ["range", "tail", "doc_id", "text", "mark"])

    rows = common.arrow_map(held, deal, "range int, tail int, doc_id long, text string, mark long")
    rows = rows.repartition(common.n_partitions(df.sparkSession), "range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "mark", "text")
    return rows.drop("mark")


def compared(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text and its successor; the last quarter of the edited text is the successor's beginning."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def of(group: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        own = [t.encode() for _, t, _ in group]
        cut = [len(t) // 4 for _, t, _ in group]
        edited = [(t[: len(t) - c] + after[:c]).encode() for (_, t, after), c in zip(group, cut, strict=True)]
        # the group's texts follow each other but for where a range begins
        fresh = [i for i in range(len(group)) if i + 1 == len(group) or group[i + 1][1] is not group[i][2]]
        e, w = prints([*own, *edited, *(group[i][2].encode() for i in fresh)])
        n = len(group)
        after = np.arange(1, n + 1)
        after[fresh] = np.arange(2 * n, 2 * n + len(fresh))
        mine, theirs, nexts = (e[:n], w[:n]), (e[n : 2 * n], w[n : 2 * n]), (e[after], w[after])
        cols = [
            pa.array([i for i, _, _ in group], pa.int64()), pa.array([len(t) for _, t, _ in group], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array([to_hex(x, y) for x, y in zip(*mine, strict=True)]), pa.array([to_hex(x, y) for x, y in zip(*theirs, strict=True)]),
            pa.array(likeness(mine, theirs)), pa.array(likeness(mine, nexts)),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, group, size = None, [], 0
        for b in batches:
            for part, tail, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if before and before[0] == part and not before[1]:
                    group.append((before[2], before[3], t))
                    size += len(before[3])
                    if size > CHUNK:
                        yield of(group)
                        group, size = [], 0
                before = (part, tail, i, t)
        if group:
            yield of(group)

    return with_next(df, key, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(common.table(spark, sf_dir, "documents"))
