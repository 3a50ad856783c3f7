"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each task keeps one codec.  The distinct pre-tokens of a batch that it has not
met yet are laid out side by side, every adjacent pair is mapped to all its
positions, and the pairs' merge ranks are applied in ascending order; a merge
touches only the lists of the pairs beside it.  A merge of rank r makes only
pairs of a higher rank, so one ascending pass over all pre-tokens together
equals merging each of them alone.

Null and empty texts have no tokens.  A pre-token may be as long as a text: the
index makes its cost n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Public GPT-2 style split; the letter branch comes first because no other branch can start with a letter.
SPLIT = regex.compile(r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for Latin-1 texts, with the classes spelled out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pre-tokens kept per task, and characters of text split at a time; bounds on memory, not on results.
CACHE, CHUNK = 400_000, 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    most = CACHE

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        self.path, self.library = path, None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs] + [1 << 62], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.pairs = keys[self.rank]  # (left id, right id) in one integer, sorted; rank holds their ranks
        self.made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
            return LATIN.findall(text)
        except UnicodeEncodeError:
            pass
        if "Cn" not in map(unicodedata.category, set(text)):
            return SPLIT.findall(text)
        # the class of such characters depends on the Unicode version: the tokenizer library decides
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` (distinct, not met yet) into the cache."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(lengths) - lengths
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:] - 1] = after[n - 1] = before[first] = -1
        at: dict[int, list[np.ndarray]] = {}  # the index: rank of a pair -> all positions of the pair
        heap: list[int] = []  # its ranks

        def note(places: np.ndarray, pairs: np.ndarray) -> None:
            i = np.searchsorted(self.pairs, pairs)
            hit = np.flatnonzero(self.pairs[i] == pairs)
            ranks = self.rank[i[hit]]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[hit[order]]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for k, x, y in zip(ranks[[0, *cuts]].tolist() if len(ranks) else (), bounds, bounds[1:], strict=False):
                if k in at:
                    at[k].append(places[x:y])
                else:
                    at[k] = [places[x:y]]
                    heapq.heappush(heap, k)

        p = np.flatnonzero(after >= 0)
        note(p, sym[p] << 32 | sym[p + 1])
        while heap:
            r = heapq.heappop(heap)
            found = at.pop(r)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            a, b, new = self.made[r]
            q = after[p]
            ok = (q >= 0) & (sym[p] == a) & (sym[q] == b)
            p, q = p[ok], q[ok]
            if a == b and len(p) > 1:  # a run of one symbol: pairs may overlap, the left one goes first
                p = np.unique(p)
                end, chosen = -1, []
                for x, y in zip(p.tolist(), after[p].tolist(), strict=True):
                    if x != end:
                        chosen.append(x)
                        end = y
                p = np.array(chosen)
                q = after[p]
            if not len(p):
                continue
            nxt = after[q]
            sym[p], sym[q], after[p] = new, -1, nxt
            has = nxt >= 0
            before[nxt[has]] = p[has]
            prev = before[p]
            left = prev[prev >= 0]
            right = p[has]
            note(np.concatenate((left, right)), np.concatenate((sym[left] << 32 | new, new << 32 | sym[nxt[has]])))
        kept = sym >= 0
        ends = np.cumsum(kept)[first + lengths - 1].tolist()
        blob = sym[kept].astype("<u4").tobytes()
        start = 0
        for w, e in zip(words, ends, strict=True):
            self.cache[w] = blob[4 * start : 4 * e]
            start = e

    def blobs(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list] = []
        size = 0

        def flush():
            nonlocal group, size
            if len(self.cache) > self.most:
                self.cache.clear()
            # one look-up per word; words without ids are learnt together, then filled in
            known = [[list(map(self.cache.get, p)) if p.__class__ is list else p for p in parts] for parts in group]
            fresh: set[str] = set()
            for parts, found in zip(group, known, strict=True):
                for p, f in zip(parts, found, strict=True):
                    if f.__class__ is list and None in f:
                        fresh.update([w for w, x in zip(p, f, strict=True) if x is None])
            if fresh:
                self.learn(list(fresh))
            for parts, found in zip(group, known, strict=True):
                done = []
                for p, f in zip(parts, found, strict=True):
                    if f.__class__ is list:
                        f = b"".join([self.cache[w] if x is None else x for w, x in zip(p, f, strict=True)] if None in f else f)
                    done.append(f)
                out.append(b"".join(done))
            group, size = [], 0

        for text in texts:
            if not text:
                parts = []
            elif self.cut is None or not any(s in text for s in self.special):
                parts = [self.words(text)]
            else:
                pieces = self.cut.split(text)
                parts = [array("I", [self.special[p]]).tobytes() if i % 2 else self.words(p) for i, p in enumerate(pieces)]
            group.append(parts)
            size += len(text or "")
            if size > CHUNK:
                flush()
        flush()
        return out

    def decode(self, blob: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(blob, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per path and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def per_task(df: DataFrame, per_batch, schema: str, path: str) -> DataFrame:
    """``arrow_map`` that empties the codec's cache when a task ends."""
    return common.arrow_map(df, per_batch, schema, lambda: codec(path).cache.clear())


def encode(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (binary: little-endian uint32), ``n_tokens``."""
    path = path or default_path()
    kinds = dict(df.dtypes)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        blobs = codec(path).blobs(b.column("__text").to_pylist())
        cols = [b.column(k) for k in keep]
        return pa.RecordBatch.from_arrays([*cols, pa.array(blobs, pa.binary()), pa.array([len(x) // 4 for x in blobs], pa.int64())], [*keep, "ids", "n_tokens"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids binary", "n_tokens long"])
    return per_task(df.select(*keep, df[text].alias("__text")), batch, schema, path)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``: what the ids stand for (UTF-8, faulty bytes replaced)."""
    path = path or default_path()
    kinds = dict(df.dtypes)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec(path).decode(x or b"").decode("utf-8", "replace") for x in b.column("__ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string"])
    return common.arrow_map(df.select(*keep, df[ids].alias("__ids")), batch, schema)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, on demand ``ids``."""
    path = path or default_path()
    kinds = dict(df.dtypes)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        blobs = c.blobs(b.column("__text").to_pylist())
        made = [len(x) // 4 for x in blobs]
        ids = [hashlib.sha256(x).hexdigest() for x in blobs]
        back = [hashlib.sha256(c.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in blobs]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(made, pa.int64()), pa.array(ids), pa.array(back), *([pa.array(blobs, pa.binary())] if with_ids else [])], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids binary"] * with_ids])
    return per_task(df.select(*keep, df[text].alias("__text")), batch, schema, path)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))


assert sys.byteorder == "little"  # array("I") above
