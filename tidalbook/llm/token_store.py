"""Token-id shards with a minimal perfect hash index.

A shard is one file: a header of ``HEADER`` bytes, the raw ids of its documents
one after the other (16 bits each if the vocabulary allows, else 32), and an
index that takes a document key to the place of its ids in constant time.  The
index is a minimal perfect hash (hash and displace): a key's bucket has a seed,
the seed and the key give a slot, the slot holds offset, length and a 32-bit
fingerprint of the key, which rejects keys that are not in the shard.  ``Shard``
reads the index and seeks to single documents; no other byte of ids is read.

The files lie in ``<path>/ids``, in any store that pyarrow's file systems reach
(local or mounted folders, S3, GCS, HDFS).  A small Parquet table, ``<path>/shards``,
names them with their first and last keys and their sizes.  A file's name and
bytes follow from the data alone and it is moved to its place when it is
complete, so a task that runs again writes the same file once more.

Shards follow ascending doc_id.  A key is (doc_id, how many rows before it have
the same doc_id); rows of one doc_id follow each other in an order that follows
from their texts; a null doc_id comes first.  A doc_id that fills several key
ranges, or rows without one, are dealt over them by a hash of the text, so that
no task gets them all.  Null and empty texts have only the end id.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: Bytes of ids after which a shard ends, and key ranges per shuffle partition.
SHARD_BYTES, RANGES = 8 << 20, 4
#: Bytes of a shard's header, and the largest gap between two documents that one read spans.
HEADER, GAP = 256, 64 << 10
M64 = (1 << 64) - 1


class LibraryCodec(bpe.Codec):
    """Each distinct pre-token goes through the tokenizers library's model once; texts are gathered from those ids.

    Pre-tokens are looked up once per distinct one of a group of texts.  Their
    ids lie in one growing array, which lasts over a worker's tasks.
    """

    most = 2_000_000

    def __init__(self, path: str):
        super().__init__(path)
        self.model = None
        self.forget()

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.first, self.size, self.tokens, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4"), 0

    def blobs(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size > bpe.CHUNK:
                out += self.gathered(group)
                group, size = [], 0
        return out + self.gathered(group) if group else out

    def gathered(self, texts: list[str]) -> list[bytes]:
        words: list[str] = []
        upto = [0]  # the number of words before each text
        for text in texts:
            if text and self.cut is not None and any(s in text for s in self.special):
                for i, p in enumerate(self.cut.split(text)):
                    words += [p] if i % 2 else self.words(p)
            elif text:
                words += self.words(text)
            upto.append(len(words))
        if not words:
            return [b""] * len(texts)
        found = pa.array(words, pa.string()).dictionary_encode()
        distinct, code = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if len(self.where) > self.most:
            self.forget()
        place = np.fromiter(map(self.where.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = len(self.where) + np.arange(len(fresh))
            self.learn([distinct[i] for i in fresh.tolist()])
        first, n = self.first[place][code], self.size[place][code]
        ends = np.cumsum(n)
        tokens = self.tokens[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[upto].tolist()
        return [tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def learn(self, words: list[str]) -> None:
        """Adds the ids of words that are not known yet, in their order."""
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path).model
            self.chars = dict(enumerate(bpe.byte_chars()))
        # the model takes the bytes' stand-ins; words without line feeds are put into them together
        plain = [w for w in words if "\n" not in w]
        shown = dict(zip(plain, "\n".join(plain).encode().decode("latin-1").translate(self.chars).split(self.chars[10]), strict=True)) if plain else {}
        ids, size = array("I"), []
        for w in words:
            if w in self.special:  # no pre-token holds a special token's string, so both may lie in one store
                own = [self.special[w]]
            else:
                own = [t.id for t in self.model.tokenize(shown[w] if w in shown else w.encode().decode("latin-1").translate(self.chars))]
            ids.extend(own)
            size.append(len(own))
        n, total = len(self.where), self.used + len(ids)
        self.first, self.size, self.tokens = grown(self.first, n + len(words)), grown(self.size, n + len(words)), grown(self.tokens, total)
        self.size[n : n + len(words)] = size
        self.first[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.tokens[self.used : total] = np.frombuffer(ids, np.uint32)
        self.used = total
        self.where.update(zip(words, range(n, n + len(words)), strict=True))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` values at least, twice as much if it had less."""
    return x if len(x) >= n else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


_codecs: dict[str, LibraryCodec] = {}


def mixed(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser (splitmix64) of keys under seeds."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hashes(ids: list[int | None], nth: list[int], salt: int = 0) -> np.ndarray:
    x = np.array([0x5EED if i is None else i & M64 for i in ids], np.uint64)
    return mixed(mixed(x, np.array([i is None for i in ids], np.uint64) + np.uint64(2 * salt)), np.array(nth, np.uint64) + np.uint64(7))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket (a negative one names the slot itself) and the slot of each key; ``keys`` are distinct.

    Buckets of one size are placed together, the largest first: each tries some
    seeds at a time, and of buckets that want one slot the first gets it.
    """
    n, m = len(keys), len(keys) // 2 + 1
    bucket = (mixed(keys, 101) % np.uint64(m)).astype(np.int64)
    seeds, slots, taken = np.zeros(m, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
    order, counts = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=m)
    start = np.cumsum(counts) - counts
    for size in np.unique(counts[counts > 1])[::-1].tolist():
        left = np.flatnonzero(counts == size)
        rows = order[start[left][:, None] + np.arange(size)]
        base = np.ones(len(left), np.int64)
        while len(left):
            width = min(256, max(1, 4096 // rows.size))
            tries = base[:, None] + np.arange(width)
            s = (mixed(keys[rows][:, None, :], (1000 + tries[:, :, None]).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
            inside = np.sort(s, axis=2)
            ok = ~taken[s].any(2) & (inside[:, :, 1:] != inside[:, :, :-1]).all(2)
            hit, at = ok.any(1), ok.argmax(1)
            h = np.flatnonzero(hit)
            chosen = s[h, at[h]]
            _, lead, which = np.unique(chosen.ravel(), return_index=True, return_inverse=True)
            won = (lead[which].reshape(chosen.shape) // size == np.arange(len(h))[:, None]).all(1)
            w = h[won]
            taken[chosen[won].ravel()] = True
            slots[rows[w]], seeds[left[w]] = chosen[won], tries[w, at[w]]
            base = np.where(hit, base + at, base + width)
            rest = np.ones(len(left), bool)
            rest[w] = False
            left, rows, base = left[rest], rows[rest], base[rest]
    alone = np.flatnonzero(counts == 1)
    free = np.flatnonzero(~taken)
    slots[order[start[alone]]], seeds[alone] = free, -1 - free
    return seeds, slots


def find(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, if it is in the index at all."""
    seed = seeds[(mixed(keys, 101) % np.uint64(n // 2 + 1)).astype(np.int64)].astype(np.int64)
    return np.where(seed < 0, -1 - seed, (mixed(keys, (1000 + np.maximum(seed, 0)).astype(np.uint64)) % np.uint64(n)).astype(np.int64))


def prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 77) >> np.uint64(32)).astype(np.uint32)


#: Stands for a null doc_id.
LOW = -(1 << 63)


def ranges(docs: DataFrame, n: int, key: str = "doc_id") -> list[int]:
    """At most ``n`` - 1 ascending keys that part ``docs`` into ranges of about as many rows; a key that fills several ranges stands several times."""
    known = F.coalesce(F.col(key).cast("long"), F.lit(LOW))
    return sorted(docs.agg(F.percentile_approx(known, [i / n for i in range(1, n)], 20 * n)).first()[0] or []) if n > 1 else []


def keys_of(ids: pa.Array) -> np.ndarray:
    return np.array([LOW if i is None else i for i in ids.to_pylist()], np.int64)


def range_numbers(keys: np.ndarray, marks: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The range of each key; one that stands several times among the cuts goes by its mark (the text's hash)."""
    at = np.array(cuts, np.int64)
    low, high = np.searchsorted(at, keys, side="left"), np.searchsorted(at, keys, side="right")
    wide = high - low > 1
    own = high.copy()
    own[wide] = low[wide] + 1 + (marks[wide].view(np.uint64) % (high - low)[wide].astype(np.uint64)).astype(np.int64)
    return own.astype(np.int32)


@dataclass
class Layout:
    """The cuts between ranges, and for each key that lies in several of them: these, and how many of its rows come before each."""

    cuts: list[int]
    several: dict[int, tuple[list[int], list[int]]]


def layout(docs: DataFrame, n: int, key: str, text: str) -> Layout:
    cuts = ranges(docs, n, key)
    hot = {c: (cuts.index(c), k) for c, k in Counter(cuts).items() if k > 1}
    several: dict[int, tuple[list[int], list[int]]] = {}
    if hot:  # at most half as many as there are cuts
        wide = docs.sparkSession.createDataFrame([(c, low, k) for c, (low, k) in hot.items()], "k long, low int, width int")
        # the mark counts as unsigned: what is left by its two halves
        mark, width = F.xxhash64(F.col(text)), F.col("width").cast("long")
        left = F.pmod(F.pmod(F.shiftrightunsigned(mark, 1), width) * 2 + mark.bitwiseAND(F.lit(1)), width)
        rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("k"), mark.alias("mark"), F.col(text)).join(F.broadcast(wide), "k")
        counts = rows.groupBy("k", (F.col("low") + 1 + left).cast("int").alias("r")).count().orderBy("k", "r").collect()
        for c, own in itertools.groupby(counts, key=lambda r: r["k"]):
            found = [(r["r"], r["count"]) for r in own]
            several[c] = [r for r, _ in found], list(itertools.accumulate((m for _, m in found[:-1]), initial=0))
    return Layout(cuts, several)


def encoded(df: DataFrame, cuts: list[int], end: int | None, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``range``, ``ids`` (as stored, packed for the way)."""

    def batch(b: pa.RecordBatch) -> dict:
        if path not in _codecs:
            _codecs[path] = LibraryCodec(path)
        codec = _codecs[path]
        width = "<u2" if len(codec.bytes) <= 1 << 16 else "<u4"
        pack = zstandard.ZstdCompressor(level=1).compress
        tail = b"" if end is None else np.array([end], width).tobytes()
        ids = [pack(np.frombuffer(x, "<u4").astype(width).tobytes() + tail) for x in codec.blobs(b.column(1).to_pylist())]
        return {"doc_id": b.column(0), "range": pa.array(range_numbers(keys_of(b.column(0)), b.column(2).to_numpy(), cuts)), "ids": pa.array(ids, pa.binary())}

    return common.arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text), F.xxhash64(F.col(text))), batch, "doc_id long, range int, ids binary")


#: Columns of the table of shards.
SHARD = "range int, part int, name string, n_docs long, n_ids long, first_id long, first_nth long, last_id long, last_nth long"


#: Spark's names of stores that Arrow knows by another.
NAMES = {"s3a": "s3", "s3n": "s3"}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named by a URI or a path, and its path there.

    Ids are written through Arrow's file systems: local and mounted folders,
    S3 (``s3``, and Spark's ``s3a`` and ``s3n``), Google's (``gs``), Azure's (``abfs``) and HDFS.
    """
    local = uri.startswith("/")
    if local or uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + (uri if local else uri[5:]).lstrip("/")
    scheme, rest = uri.split(":", 1)
    try:
        return pafs.FileSystem.from_uri(f"{NAMES.get(scheme, scheme)}:{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"{uri}: ids go through Arrow, which has no file system for {scheme}; let spark.checkpoint.dir name a folder in one that it has (file, s3, s3a, s3n, gs, abfs, hdfs)") from e


def write_shard(folder: str, name: str, rows: list[tuple[int | None, int, bytes]], width: int) -> None:
    """One file of the given documents (``doc_id``, ``nth``, packed ids), in their order."""
    salt = 0
    while True:
        keys = key_hashes([r[0] for r in rows], [r[1] for r in rows], salt)
        if len(np.unique(keys)) == len(keys):
            break
        salt += 1
    seeds, slots = build_index(keys)
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    offsets, lengths, marks = np.empty_like(sizes), np.empty_like(sizes), np.empty(len(rows), np.uint32)
    offsets[slots], lengths[slots], marks[slots] = np.cumsum(sizes) - sizes, sizes, prints(keys)
    head = json.dumps({"format": 1, "width": width, "docs": len(rows), "bytes": int(sizes.sum()), "salt": salt}).encode().ljust(HEADER)
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    fresh = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(fresh, compression=None) as f:
        f.write(head)
        f.write(b"".join([r[2] for r in rows]))
        for x in (offsets, lengths, marks, seeds):
            f.write(x.tobytes())
    fs.move(fresh, f"{path}/{name}")


class Shard:
    """Keyed access to one file: the index is read once, each document by its offset."""

    def __init__(self, folder: str, name: str):
        fs, path = store(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        head = json.loads(self.file.read_at(HEADER, 0))
        self.n, self.salt, self.kind, size = head["docs"], head["salt"], f"<u{head['width']}", head["bytes"]
        raw = self.file.read_at(20 * self.n + 4 * (self.n // 2 + 1), HEADER + size)
        self.offsets, self.lengths = np.frombuffer(raw, np.int64, self.n), np.frombuffer(raw, np.int64, self.n, 8 * self.n)
        self.marks, self.seeds = np.frombuffer(raw, np.uint32, self.n, 16 * self.n), np.frombuffer(raw, np.int32, -1, 20 * self.n)

    def places(self, ids: list[int | None], nth: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, where its ids begin (in ids) and how many they are."""
        keys = key_hashes(ids, nth, self.salt)
        slots = find(keys, self.seeds, self.n)
        width = int(self.kind[2:])
        return self.marks[slots] == prints(keys), self.offsets[slots] // width, self.lengths[slots] // width

    def read(self, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """The ids at each place, in turn; places that lie close together are read at once."""
        width = int(self.kind[2:])
        a, b = offsets * width, (offsets + lengths) * width
        i = 0
        while i < len(a):
            j, low, high = i + 1, int(a[i]), int(b[i])
            while j < len(a) and low <= a[j] <= high + GAP and b[j] - low <= SHARD_BYTES:
                high, j = max(high, int(b[j])), j + 1
            raw = self.file.read_at(high - low, HEADER + low)
            for k in range(i, j):
                yield np.frombuffer(raw, self.kind, int(lengths[k]), int(a[k]) - low)
            i = j

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or nothing if the key is not there."""
        ok, at, n = self.places([doc_id], [nth])
        return next(self.read(at, n)).astype("<u4") if ok[0] else None

    def close(self) -> None:
        self.file.close()


def shards(ids: DataFrame, folder: str, width: int, several: dict[int, tuple[list[int], list[int]]]) -> DataFrame:
    """Writes the files of encoded documents and gives a row for each: each task takes whole ranges in order and cuts them by size."""

    def pack(block: int, part: int, rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        name = f"{block:06d}-{part:06d}.ids"
        write_shard(folder, name, rows, width)
        row = (block, part, name, len(rows), sum(len(r[2]) for r in rows) // width, *rows[0][:2], *rows[-1][:2])
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        unpack = zstandard.ZstdDecompressor().decompress
        block, part, size, last, nth = None, 0, 0, object(), 0
        for b in batches:
            for i, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(unpack, b.column(2).to_pylist()), strict=True):
                if rows and (r != block or size >= SHARD_BYTES):
                    yield pack(block, part, rows)
                    rows, size, part = [], 0, part + 1
                if r != block:
                    block, part, last = r, 0, object()
                nth = nth + 1 if i == last else first.get((LOW if i is None else i, r), 0)
                last = i
                rows.append((i, nth, x))
                size += len(x)
        if rows:
            yield pack(block, part, rows)

    first = {(c, r): m for c, own in several.items() for r, m in zip(*own, strict=True)}
    names, types = zip(*(c.split() for c in SHARD.split(", ")), strict=True)
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t] for t in types]
    n = common.n_partitions(ids.sparkSession)
    dealt = ids.repartition(n, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    return dealt.mapInArrow(run, SHARD)


def write(df: DataFrame, path: str, end: int | None = None, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> Layout:
    """Encodes ``df`` and writes its shards to ``path``; returns the layout of key ranges."""
    tokenizer = tokenizer or bpe.default_path()
    width = 2 if len(LibraryCodec(tokenizer).bytes) <= 1 << 16 else 4
    store(path)  # fails before the work is done, not after
    made = layout(df, RANGES * common.n_partitions(df.sparkSession), key, text)
    shards(encoded(df, made.cuts, end, tokenizer, key, text), f"{path}/ids", width, made.several).write.parquet(f"{path}/shards")
    return made


def lookup(keys: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Keyed access: for each (``doc_id``, ``nth``) of ``keys`` its ``start``, ``n_tokens`` and ``ids_crc32``.

    The keys of a range meet the names of its shards in one task, which opens
    the files and reads the places of the keys; ids are never shuffled.  The
    driver adds up one number per range.
    """
    stored = keys.sparkSession.read.schema(SHARD).parquet(f"{path}/shards")
    totals = dict(map(tuple, stored.groupBy("range").agg(F.sum("n_ids")).collect()))
    blocks = sorted(totals)
    starts = dict(zip(blocks, itertools.accumulate((totals[r] for r in blocks), initial=0), strict=False))
    folder = f"{path}/ids"

    def dealt(b: pa.RecordBatch) -> dict:
        own, nth = keys_of(b.column(0)), b.column(1).to_numpy()
        part = range_numbers(own, np.zeros(len(own), np.int64), layout.cuts)
        for c, (blocks, before) in layout.several.items():
            at = own == c
            part[at] = np.array(blocks, np.int32)[np.searchsorted(before, nth[at], side="right") - 1]
        return {"doc_id": b.column(0), "nth": b.column(1), "range": pa.array(part)}

    def place(i: object, nth: int) -> tuple:
        return (i is not None, i or 0, nth)

    def read(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        want = sorted(zip(asked.column("doc_id").to_pylist(), asked.column("nth").to_pylist(), strict=True), key=lambda k: place(*k))
        start, i = starts.get(key[0].as_py(), 0), 0
        for s in sorted(there.to_pylist(), key=lambda s: s["part"]):
            low, high = place(s["first_id"], s["first_nth"]), place(s["last_id"], s["last_nth"])
            while i < len(want) and place(*want[i]) < low:
                i += 1
            j = i
            while j < len(want) and place(*want[j]) <= high:
                j += 1
            if j > i:
                shard = Shard(folder, s["name"])
                ok, at, n = shard.places(*map(list, zip(*want[i:j], strict=True)))
                hits = np.flatnonzero(ok)
                for k, ids in zip(hits.tolist(), shard.read(at[hits], n[hits]), strict=True):
                    out.append((want[i + k][0], start + int(at[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                shard.close()
            start, i = start + s["n_ids"], j
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    asked = common.arrow_map(keys.select("doc_id", "nth"), dealt, "doc_id long, nth long, range int")
    # dealt by number, else Spark would merge the tasks by the little that they shuffle, not by what they read
    n = common.n_partitions(keys.sparkSession)
    asked, stored = asked.repartition(n, "range"), stored.repartition(n, "range")
    return asked.groupBy("range").cogroup(stored.groupBy("range")).applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Rows of one doc_id that are numbered by one array.
LOT = 10_000


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of all rows: ``doc_id``, and ``nth`` from 0 among the rows that share it; by lots, so that no array grows with a hot id."""
    counts = docs.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    lots = counts.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    within = F.sequence(F.col("lot") * LOT, F.least(F.col("n"), (F.col("lot") + 1) * LOT) - 1)
    # lots of one id go their ways before they are numbered
    return lots.repartition(common.n_partitions(docs.sparkSession), "doc_id", "lot").select("doc_id", F.explode(within).alias("nth"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    made = write(docs, path, end=2)
    return lookup(numbered(docs), path, made)
