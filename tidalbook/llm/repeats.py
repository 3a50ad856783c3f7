"""Removal of long repeats with run-length suffix indexes.

Every byte is removed that a ``depth``-byte string covers which also starts in
a document with a smaller doc_id; texts count as UTF-8 and matches never cross
documents.  Strings are judged on the input.

One index over a whole corpus does not fit a task, so text meets by content.
Each ``depth``-byte window has an anchor, its ``GRAM``-byte string of the
smallest hash: equal windows have equal anchors, about one in sixteen bytes is
one.  Windows in a row with one anchor form a segment.

1. Documents are packed in blocks by doc_id.  Each block sends its distinct
   anchors' hashes, in one sorted array per bucket, and each bucket answers
   which of them stand in two documents at least.
2. Each block sends its distinct segments of shared anchors to the anchors'
   buckets, with the smallest doc_id of each: copies inside a block travel once.
   A bucket merges equal segments of all blocks.  Where an anchor has one
   segment only, that segment's smallest doc_id holds for all its windows; the
   others go into run-length indexes (``run_index``) of about ``SEGMENTS`` bytes,
   which are streamed for the smallest doc_id of each window.
3. Each block marks the windows of its documents that an earlier one has.

Blocks and buckets number in proportion to the corpus; a bucket serves more text
than a block, so that the rows between them stay few.  A hot passage weighs
on its buckets once per block, however many documents hold it; where there are
more than ``FAN`` blocks, a bucket's segments are first merged by lots of
blocks, so that no task gets more than ``FAN`` copies of one.

Null and empty texts have no bytes.  A null doc_id is larger than all others.
Rows that share a doc_id don't take bytes from each other.  Columns that are
carried along stay as they are, whatever their type.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .run_index import RunIndex
from .words import scrambled

DEPTH, GRAM = 50, 20
SPAN = DEPTH - GRAM + 1
#: Bytes of text per block, per bucket of segments and per bucket of anchors; blocks and buckets at least.
BLOCK, SHELF, ANCHORS, LEAST = 2 << 20, 8 << 20, 32 << 20, 64
#: Bytes of segments per index, and buckets of other segments for each of hot ones.
SEGMENTS, FEWER = 1 << 17, 8
#: Bytes of text that a task deals to the blocks at a time, and blocks whose segments meet in one task.
PIECE, FAN = 16 << 20, 64
#: Windows that are looked at together, so that their numbers stay in the cache.
STRETCH = 1 << 15
LAST = (1 << 63) - 1

_TABLE = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _pack(x: np.ndarray) -> bytes:
    return x.tobytes()


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(x, kind)


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column over one buffer: row i is what of ``data`` lies between the ends before and at it (0 is the first); costs nothing a row."""
    at = (np.asarray(ends) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a binary column as one array, and how many values each has."""
    parts, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            whole = np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            parts.append(np.frombuffer(whole.tobytes(), kind))
            sizes.append(np.diff(at) // np.dtype(kind).itemsize)
    return np.concatenate(parts), np.concatenate(sizes).astype(np.int64)


def _frozen(x: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", x.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([x], ["x"]))
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _thawed(x: bytes) -> pa.Array:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all().column(0).combine_chunks()


class Block:
    """The documents of a block, in ascending order, and the segments of their text."""

    def __init__(self, rows: dict[str, list]):
        rest = [_thawed(x) for x in rows["carried"] if x]
        ids = np.concatenate([_unpack(x, np.int64) for x in rows["ids"]])
        nulls = np.concatenate([_unpack(x, np.uint8) for x in rows["nulls"]])
        sizes = np.concatenate([_unpack(x, np.int64) for x in rows["sizes"]])
        text = b"".join(map(zstandard.ZstdDecompressor().decompress, rows["texts"]))
        starts = np.cumsum(sizes) - sizes
        texts = [text[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.nulls, self.texts = ids[order], nulls[order], [texts[i] for i in order]
        self.sizes, self.carried = sizes[order], pa.concat_arrays(rest).take(pa.array(order, pa.int64())) if rest else None
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.segment()

    def segment(self) -> None:
        """Sets ``first`` (a segment's first window), ``count`` (its windows), ``anchor`` (hash), ``owner`` (document number)."""
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        self.first = self.count = self.owner = empty
        self.anchor = self.gram16 = np.zeros(0, np.uint64)
        if n < DEPTH:
            return
        at = np.empty(n - DEPTH + 1, np.int32 if n < LAST >> 32 else np.int64)  # the anchor of each window
        self.gram16, grams = np.empty(n - 15, np.uint64), np.empty(n - GRAM + 1, np.uint64)
        for a in range(0, len(at), STRETCH):
            z = min(a + STRETCH, len(at))
            with np.errstate(over="ignore"):
                h = _TABLE[self.data[a : z + DEPTH - 1]]
                for m, w in zip(_M, (1, 2, 4, 8), strict=False):
                    h = h[:-w] * m + h[w:]
                    four = h if w == 2 else four if w > 2 else None
                self.gram16[a : a + len(h)] = h
                h = scrambled(h[: len(h) - 4] * _M[4] + four[16 : 16 + len(h) - 4])  # GRAM = 16 + 4
            grams[a : a + len(h)] = h
            v = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)  # places in a packed value have 24 bits
            for w in (1, 2, 4, 8):
                v = np.minimum(v[:-w], v[w:])
            v = np.minimum(v[: len(v) - (SPAN - 16)], v[SPAN - 16 :])
            at[a:z] = (v & np.uint64(0xFFFFFF)).astype(np.int64) + a
        has = self.sizes >= DEPTH
        new = np.concatenate(([True], at[1:] != at[:-1]))
        new[self.starts[has]] = True
        # windows that cross a document's end
        for back in range(1, DEPTH):
            over = self.starts + self.sizes - back
            new[over[(over >= 0) & (over < len(at))]] = False
        self.first = np.flatnonzero(new)
        own = np.searchsorted(self.starts, self.first, side="right") - 1
        end = (self.starts + self.sizes)[own] - DEPTH + 1  # of the document's windows
        self.count = np.minimum(np.append(self.first[1:], len(at)), end) - self.first
        self.anchor = grams[at[self.first]]
        self.owner = own
        # empty documents share a start with the next one: searchsorted gives the last of them, which holds the text

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.count, self.anchor, self.owner = (x[chosen] for x in (self.first, self.count, self.anchor, self.owner))

    def names(self) -> np.ndarray:
        """A hash of each segment's bytes; its 16-byte parts overlap to cover it."""
        size = self.count + DEPTH - 1
        with np.errstate(over="ignore"):
            x = size.astype(np.uint64) * _M[0]
            for off in (0, 16, 32):
                x = scrambled(x * _M[1] + self.gram16[self.first + off])
            for off in (np.minimum(48, size - 16), size - 16):
                x = scrambled(x * _M[1] + self.gram16[self.first + off])
        return x


def slices(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    ahead = np.cumsum(size) - size
    out = np.empty(int(size.sum()), data.dtype)
    for i in range(0, len(size), 4_096):  # so many at a time that their places stay in the cache
        n, start = size[i : i + 4_096], ahead[i]
        out[start : start + n.sum()] = data[np.repeat(first[i : i + 4_096] - ahead[i : i + 4_096] + start, n) + np.arange(int(n.sum()))]
    return out


def buckets_of(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def blocks_of(df: DataFrame, key: str, text: str, n: int, carry: list[str]) -> DataFrame:
    """Documents packed by block: ``block``, ``ids``, ``nulls``, ``sizes``, ``texts``, ``carried`` (the last two compressed; ``carried``: an Arrow stream, empty if nothing is carried).

    The id and the text name the block, so that null or repeated ids don't meet in one.
    """

    def dealt(ids: list, texts: list[bytes], rest: list[pa.Array]) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        keys = np.array([LAST if i is None else i for i in ids], np.int64)
        nulls = np.array([i is None for i in ids], np.uint8)
        sizes = np.array(list(map(len, texts)), np.int64)
        marks = np.array(list(map(zlib.crc32, texts)), np.uint64)
        with np.errstate(over="ignore"):
            part = (scrambled(scrambled(keys.view(np.uint64)) + marks) % np.uint64(n)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        held = pa.concat_arrays(rest) if rest else None
        block, ends = runs(part[order])
        each = np.split(order, ends[1:-1])
        squeezed = pa.array([squeeze(b"".join([texts[i] for i in own.tolist()])) for own in each], pa.binary())
        carried = pa.array([_frozen(held.take(pa.array(own))) if held is not None else b"" for own in each], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(block), *(_cut(x[order], ends) for x in (keys, nulls, sizes)), squeezed, carried], ["block", "ids", "nulls", "sizes", "texts", "carried"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, rest, size = [], [], [], 0
        for b in batches:
            ids += b.column(0).to_pylist()
            fresh = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            texts += fresh
            rest += [b.column(2)] if b.num_columns > 2 else []
            size += sum(map(len, fresh))
            if size > PIECE:
                yield dealt(ids, texts, rest)
                ids, texts, rest, size = [], [], [], 0
        if ids:
            yield dealt(ids, texts, rest)
        ids = texts = rest = None
        common.release()

    held = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *held)
    packed = rows.mapInArrow(pack, "block int, ids binary, nulls binary, sizes binary, texts binary, carried binary")
    return packed.repartition(common.n_partitions(df.sparkSession), "block")


def shared_anchors(blocks: DataFrame, n: int) -> DataFrame:
    """``block``, ``bucket``, ``shared``, ``hot``: the anchors of the block in that bucket that two documents hold, and which of them more than ``FAN`` blocks hold."""

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        b = Block(rows.to_pydict())
        # a document's anchors are those of its text; ids tell documents apart
        code = (buckets_of(b.anchor, n).astype(np.uint64) << np.uint64(32)) | (b.anchor & np.uint64(0xFFFFFFFF))
        order = np.argsort(code)
        code, owner = code[order], b.ids[b.owner[order]] if len(code) else order
        lead = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else order
        twice = np.maximum.reduceat(owner, lead) != np.minimum.reduceat(owner, lead) if len(code) else np.zeros(0, bool)
        code = code[lead]
        bucket, ends = runs((code >> np.uint64(32)).astype(np.int32))
        return pa.table([pa.array(np.full(len(bucket), key[0].as_py(), np.int32)), pa.array(bucket), _cut(code.astype(np.uint32), ends), _cut(twice.astype(np.uint8), ends)], ["block", "bucket", "codes", "twice"])

    def answer(rows: pa.Table) -> pa.Table:
        every, sizes = _joined(rows.column("codes"), np.uint32)
        marked, _ = _joined(rows.column("twice"), np.uint8)
        order = np.argsort(every)
        lead = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        blocks = np.diff(np.append(lead, len(every)))
        many = (blocks > 1) | (np.maximum.reduceat(marked[order], lead) > 0)
        ok, hot = np.empty(len(every), bool), np.empty(len(every), np.uint8)
        ok[order], hot[order] = np.repeat(many, blocks), np.repeat(blocks > FAN, blocks)
        ends = np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], np.cumsum(sizes)))]
        out = pa.table([rows.column("block"), rows.column("bucket"), _cut(every[ok], ends), _cut(hot[ok], ends)], ["block", "bucket", "shared", "hot"])
        return out.filter(pa.array(np.diff(ends) > 0))

    sent = blocks.groupBy("block").applyInArrow(send, "block int, bucket int, codes binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block int, bucket int, shared binary, hot binary")


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array, and where each ends (with 0 before the first)."""
    if not len(ordered):
        return ordered, np.zeros(1, np.int64)
    ends = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]))
    return ordered[ends[:-1]], ends


def shared_segments(rows: dict[str, list], side: pa.Table, n_anchors: int) -> Block:
    """The block with the segments of shared anchors only; ``hot`` tells those of anchors that more than ``FAN`` blocks hold."""
    b = Block(rows)
    codes, sizes = _joined(side.column("shared"), np.uint32)
    known = codes.astype(np.uint64) | (np.repeat(side.column("bucket").to_numpy().astype(np.uint64), sizes) << np.uint64(32))
    order = np.argsort(known)
    known, hot = known[order], _joined(side.column("hot"), np.uint8)[0][order]
    code = (buckets_of(b.anchor, n_anchors).astype(np.uint64) << np.uint64(32)) | (b.anchor & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
    kept = known[at] == code if len(known) else np.zeros(len(code), bool)
    b.keep(kept)
    b.hot = hot[at[kept]].astype(bool) if len(known) else np.zeros(0, bool)
    return b


def distinct_segments(b: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the block's distinct segments: the first occurrence, the bucket, ordered by bucket and name; and each occurrence's place in that order.

    Hot segments have buckets of their own, from ``n`` on; fewer, as each of them stands in more than ``FAN`` blocks.
    """
    name = b.names()
    bucket = np.where(b.hot, n + buckets_of(b.anchor, max(LEAST, n // FEWER)), buckets_of(b.anchor, n))
    order = np.argsort(name)
    order = order[np.argsort(bucket[order].astype(np.uint16 if n < 1 << 15 else np.int64), kind="stable")]
    lead = np.concatenate(([True], name[order][1:] != name[order][:-1])) if len(order) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(lead) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(lead)) if len(order) else order
    return first, bucket[first], place


#: Segments on their way: bytes, windows of each, smallest doc_ids, anchors' marks; ``lot``: of hot buckets, which blocks meet first, else -1.
SENT = "block int, bucket int, lot int, texts binary, counts binary, low binary, marks binary"
#: What a meeting gives: answers (``counts`` and ``low`` are runs of windows and their smallest doc_ids), for lots the merged segments, and for each of their rows (``counts``) which of these its segments are (``marks``).
MET = f"kind int, {SENT}"
ANSWER, MERGED, WHICH = 0, 1, 2


def owners(blocks: DataFrame, shared: DataFrame, n_anchors: int, n: int, n_blocks: int) -> DataFrame:
    """``block``, ``bucket``, ``counts``, ``low``: runs of windows of the block's distinct segments, and their smallest doc_ids."""

    def send(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        made = [np.zeros(0, np.int32), np.zeros(1, np.int64)]
        text, count, low, mark = (np.zeros(0, k) for k in (np.uint8, np.uint8, np.int64, np.uint32))
        ahead = made[1]
        if rows.num_rows and side.num_rows:
            b = shared_segments(rows.to_pydict(), side, n_anchors)
            first, bucket, _ = distinct_segments(b, n)
            made = runs(bucket.astype(np.int32))
            size = b.count[first] + DEPTH - 1
            text, count, low, mark = slices(b.data, b.first[first], size), b.count[first].astype(np.uint8), b.ids[b.owner[first]], b.anchor[first].astype(np.uint32)
            ahead = np.concatenate(([0], np.cumsum(size)))[made[1]]
        bucket, ends = made
        common.release()
        block = key[0].as_py()
        at = [pa.array(np.full(len(bucket), block, np.int32)), pa.array(bucket), pa.array(np.where(bucket >= n, block // FAN, -1).astype(np.int32))]
        return pa.table([*at, _cut(text, ahead), _cut(count, ends), _cut(low, ends), _cut(mark, ends)], SENT_NAMES)

    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, SENT)
    return answered(sent, n_blocks)


SENT_NAMES = ["block", "bucket", "lot", "texts", "counts", "low", "marks"]


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of some rows together (bytes, counts of windows, smallest doc_ids, marks), and how many are in each row."""
    count, n = _joined(rows.column("counts"), np.uint8)
    return _joined(rows.column("texts"), np.uint8)[0], count.astype(np.int64), _joined(rows.column("low"), np.int64)[0], _joined(rows.column("marks"), np.uint32)[0], n


def distinct(data: np.ndarray, count: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each segment's text, the first segment with each text, and the text's smallest doc_id."""
    size = count + DEPTH - 1
    starts = np.cumsum(size) - size
    raw = data.tobytes()
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(raw[a : a + n], len(place)) for a, n in zip(starts.tolist(), size.tolist(), strict=True)], np.int64)
    lead = np.zeros(len(place), np.int64)
    lead[which[::-1]] = np.arange(len(which))[::-1]
    best = np.full(len(place), LAST)
    np.minimum.at(best, which, low)
    return which, lead, best


def spans_of(pick: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the windows of the picked segments, in turn, if all segments' windows lie one after the other."""
    ahead, n = np.cumsum(count) - count, count[pick]
    return np.repeat(ahead[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def in_runs(lowest: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Windows' smallest doc_ids as runs (lengths and values) that end where a segment ends, by rows of ``n`` segments."""
    new = np.zeros(len(lowest), bool)
    starts = np.cumsum(count) - count
    new[starts] = True
    new[1:] |= lowest[1:] != lowest[:-1]
    at = np.flatnonzero(new)
    rows = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(n)))]
    ends = np.searchsorted(at, rows)
    return _cut(np.diff(np.append(at, len(lowest))).astype(np.uint8), ends), _cut(lowest[at], ends)


def out_of_runs(rows: pa.Table) -> np.ndarray:
    return np.repeat(_joined(rows.column("low"), np.int64)[0], _joined(rows.column("counts"), np.uint8)[0])


def answered(sent: DataFrame, n_blocks: int) -> DataFrame:
    """``block``, ``bucket``, ``counts``, ``low`` for each row of ``sent``: a bucket's segments of all blocks meet.

    Those of hot buckets meet by lots of ``FAN`` blocks first, and what a lot
    has merged goes on as one block's; so no task gets more than ``FAN`` copies
    of a segment, however large the corpus is.
    """

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, lot = key[0].as_py(), key[1].as_py()
        data, count, low, mark, n = unpacked(rows)
        none = pa.array([b""] * rows.num_rows, pa.binary())
        at = [rows.column("block").combine_chunks(), rows.column("bucket").combine_chunks(), rows.column("lot").combine_chunks()]
        number = lambda x, k: pa.array(np.full(k, x, np.int32))
        if lot < 0:
            lengths, values = in_runs(smallest(data, count, low, mark), count, n)
            common.release()
            return pa.table([number(ANSWER, len(n)), *at, none, lengths, values, none], ["kind", *SENT_NAMES])
        which, lead, best = distinct(data, count, low)
        ends = np.concatenate(([0], np.cumsum(n)))
        told = pa.table([number(WHICH, len(n)), *at, none, _cut(count.astype(np.uint8), ends), none, _cut(which.astype(np.uint32), ends)], ["kind", *SENT_NAMES])
        size = count + DEPTH - 1
        whole = lambda x: _cut(x, np.array([0, len(x)]))
        own = [number(MERGED, 1), number(lot, 1), number(bucket, 1), number(-1 if -(-n_blocks // FAN) <= FAN else lot // FAN, 1)]
        merged = pa.table([*own, whole(data[spans_of(lead, size)]), whole(count[lead].astype(np.uint8)), whole(best), whole(mark[lead])], ["kind", *SENT_NAMES])
        return pa.concat_tables([told, merged])

    def deal(rows: pa.Table, above: pa.Table) -> pa.Table:
        which, n = _joined(rows.column("marks"), np.uint32)
        count = _joined(rows.column("counts"), np.uint8)[0].astype(np.int64)
        # the windows of each merged segment, whose number each of its copies tells
        windows = np.zeros(int(which.max()) + 1, np.int64)
        windows[which] = count
        lengths, values = in_runs(out_of_runs(above)[spans_of(which, windows)], count, n)
        return pa.table([rows.column("block").combine_chunks(), rows.column("bucket").combine_chunks(), lengths, values], ["block", "bucket", "counts", "low"])

    kind = "block int, bucket int, counts binary, low binary"
    met = sent.groupBy("bucket", "lot").applyInArrow(meet, MET)
    if n_blocks <= FAN:  # no anchor is in more blocks than there are
        return met.select("block", "bucket", "counts", "low")
    met = common.written(met, "met-segments")
    answers = met.where(F.col("kind") == ANSWER).select("block", "bucket", "counts", "low")
    above = answered(met.where(F.col("kind") == MERGED).select(SENT_NAMES), -(-n_blocks // FAN)).withColumnRenamed("block", "lot")
    told = met.where(F.col("kind") == WHICH)
    return answers.unionByName(told.groupBy("bucket", "lot").cogroup(above.groupBy("bucket", "lot")).applyInArrow(deal, kind))


def smallest(data: np.ndarray, count: np.ndarray, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each window of each segment among all given segments; anchors are taken together that make about ``SEGMENTS`` bytes."""
    size = count + DEPTH - 1
    order = np.argsort(mark)
    new = np.concatenate(([True], mark[order][1:] != mark[order][:-1])) if len(order) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    ahead = np.cumsum(size[order]) - size[order]
    parts = lead[np.flatnonzero(np.diff(ahead[lead] // SEGMENTS, prepend=-1))]
    if len(parts) < 2:
        return smallest_of_part(data, count, low, mark)
    starts, at = np.cumsum(size) - size, np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for own in np.split(order, parts[1:]):
        n = count[own]
        places = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[places] = smallest_of_part(slices(data, starts[own], size[own]), n, low[own], mark[own])
    return out


def smallest_of_part(data: np.ndarray, count: np.ndarray, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
    which, lead, best = distinct(data, count, low)
    n_windows = count[lead]
    out = np.repeat(best, n_windows)
    # only anchors with several segments need the index
    _, group, members = np.unique(mark[lead], return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    if len(several):
        size = count + DEPTH - 1
        index = RunIndex(data[spans_of(lead[several], size)], size[lead[several]], best[several], DEPTH)
        out[spans_of(several, n_windows)] = index.smallest_owners()
    return out[spans_of(which, n_windows)]


def covered(b: Block, side: pa.Table, n: int) -> np.ndarray:
    """Which bytes of the block go."""
    cover = np.zeros(len(b.data) + 1, np.int64)
    if len(b.first):
        first, _, place = distinct_segments(b, n)
        lowest = out_of_runs(side.sort_by("bucket"))
        n_windows = b.count[first]
        ahead = np.cumsum(n_windows) - n_windows
        within = np.arange(int(b.count.sum())) - np.repeat(np.cumsum(b.count) - b.count, b.count)
        earlier = lowest[np.repeat(ahead[place], b.count) + within] < np.repeat(b.ids[b.owner], b.count)
        at = (np.repeat(b.first, b.count) + within)[earlier]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + DEPTH, -1)
    return np.cumsum(cover[:-1]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` (bytes of UTF-8 text) widened to whole characters."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.maximum.reduceat(gone, lead), np.diff(np.append(lead, len(data)))) if len(data) else gone


def numbers(total: int) -> tuple[int, int, int]:
    """Blocks, buckets of segments and buckets of anchors for so many bytes of text."""
    return max(LEAST, total // BLOCK), max(2 * LEAST, total // SHELF), max(LEAST, total // ANCHORS)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (binary: what is left) and the ``carry`` columns.

    ``characters``: ``kept`` is a string instead, from which characters that were cut have gone whole.
    """
    n_blocks, n, n_anchors = numbers(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)
    blocks = blocks_of(df, key, text, n_blocks, list(carry))
    shared = common.written(shared_anchors(blocks, n_anchors), "shared-anchors")
    found = owners(blocks, shared, n_anchors, n, n_blocks)
    none = F.lit(None).cast("binary")
    side = shared.select("block", "bucket", "shared", "hot", none.alias("counts"), none.alias("low")).unionByName(found.select("block", "bucket", none.alias("shared"), none.alias("hot"), "counts", "low"))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string() if characters else pa.binary()}

    def finish(rows: pa.Table, side: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in kinds}
        carried = None
        if rows.num_rows:
            b = shared_segments(rows.to_pydict(), side.filter(side.column("shared").is_valid()), n_anchors)
            gone = covered(b, side.filter(side.column("low").is_valid()), n)
            for i, null, a, size, t in zip(b.ids.tolist(), b.nulls.tolist(), b.starts.tolist(), b.sizes.tolist(), b.texts, strict=True):
                g = gone[a : a + size]
                kept = b.data[a : a + size][~g].tobytes() if g.any() else t
                out["doc_id"].append(None if null else i)
                out["n_bytes"].append(size)
                out["n_removed"].append(size - len(kept))
                out["n_spans"].append(int((g & ~np.concatenate(([False], g[:-1]))).sum()) if size else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if characters:
                    kept = b.data[a : a + size][~whole_characters(b.data[a : a + size], g)].tobytes().decode() if g.any() else t.decode()
                out["kept"].append(kept)
            carried = b.carried
        common.release()
        made = [pa.array(v, kinds[k]) for k, v in out.items()]
        if carry:
            made.append(pa.array([], pa.null()) if carried is None else carried)
        return pa.table(made, [*kinds, *["carried"] * bool(carry)])

    schema = T.StructType.fromDDL(f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if characters else 'binary'}")
    if carry:
        schema = schema.add("carried", df.select(F.struct(*carry)).schema[0].dataType)
    done = blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(finish, schema)
    return done.select(*kinds, *(F.col("carried").getField(c).alias(c) for c in carry))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents")).drop("kept")
