"""Near-duplicate detection with HyperMinHash.

A document's set holds its distinct shingles of ``words`` words (the whole
sequence if it is shorter), lower-cased in A-Z.  Its shingle hashes fall into
buckets; a bucket's register keeps the smallest hash as a leading-zero count
(6 bits) and 10 mantissa bits.  Empty buckets borrow the next one's register.
Four registers make a band; documents that share a band are candidates.

1. Documents with equal sets are one class from the start: copies cost nothing.
2. In every band bucket all members meet one pivot, not each other: the one
   whose own buckets hold most members, as it lies nearest to the middle of a
   crowd.  What passes is united.  A second round does the same with a random
   pivot, for buckets that still hold several components.
3. Buckets that still hold several components are cut into blocks of ``BLOCK``
   members, and every two blocks meet in a task, so no task gets a whole hot
   bucket.  The largest component's members have blocks of their own, which do
   not meet each other, so rows follow the members that are still apart from
   it.  Registers tell which members may have a link to another component
   (a pair counts in its first common band only); only their sets travel there,
   and the task gives a spanning forest of the links it confirms, so no link
   between components is lost and rows stay in proportion to members.

Candidates first pass bounds that lose nothing: the smaller set must be large
enough for the share, and a bucket whose own registers differ holds an item that
only one set has, so the share allows just so many of them.  Sets of more than ``ENOUGH`` hashes a register then pass
an estimate from the registers, corrected for chance collisions, with a margin
of six standard errors; smaller sets leave buckets empty, whose registers are
borrowed and not independent, so no estimate decides there.  Then the full sets
are intersected, and only the exact share decides.  With 20 bands of 4 a pair at
0.85 shares no band with probability 4e-7, with 28 one at 0.8 with 4e-7; between
large sets the estimate drops less than 1e-7 more (a binomial bound).

Texts without words (null, empty, white space) have an empty set, belong to no
class and link with nothing.  Rows that share a doc_id get the class of their own
text each; if the doc_id is the smallest that has either text, their links add
up.  A null doc_id stays alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import components as graph
from . import words as w

ROWS, MANTISSA = 4, 10
CHUNK, BLOCK, COLUMNS = 1_500_000, 128, 1 << 15
#: The estimate decides on sets of more hashes a register than this, and with a margin of so many standard errors.
ENOUGH, ERRORS = 4, 6.0
_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, doc, _ = w.word_hashes([t.translate(_LOWER) for t in texts])
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        joint = w.scrambled(hashes + np.uint64(1))
        run = joint.copy()  # run[i]: hash of the shingle from word i, if it is there
        for k in range(1, size):
            run[:-k] = w.scrambled(run[:-k] * np.uint64(31) + joint[k:]) if len(run) > k else run[:-k]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                x = np.sort(run[a : b - size + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif b > a:
                x = np.uint64(b - a)
                for v in joint[a:b]:
                    x = w.scrambled(np.array([x * np.uint64(37) + v]))[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """One row of registers per set (n x buckets, uint16); sets are not empty."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        at = doc * buckets + (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        low = np.full(n * buckets, np.iinfo(np.uint64).max)
        np.minimum.at(low, at, w.scrambled(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(1))
    full = np.zeros(n * buckets, bool)
    full[at] = True
    zeros = (52 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1]).astype(np.int64).clip(0, 52)
    with np.errstate(over="ignore"):
        mantissa = (low << (zeros + 2).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    made = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).reshape(n, buckets)
    # empty buckets take the register of the next full one, around the end
    full = full.reshape(n, buckets)
    twice = np.where(np.concatenate((full, full), axis=1), np.arange(2 * buckets), 2 * buckets)
    nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :buckets] % buckets
    return np.take_along_axis(made, nearest, axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard from registers (rows of uint16), less what chance collisions add."""
    k = a.shape[1]
    same = (a == b).mean(1)
    # two unrelated minima agree if they have one leading-zero count and one mantissa
    chance = np.zeros(len(same))
    x, y = np.maximum(n_a / k, 1.0), np.maximum(n_b / k, 1.0)
    for z in range(40):
        hi, lo = 2.0**-z, 2.0 ** -(z + 1)
        chance += ((1 - lo) ** x - (1 - hi) ** x) * ((1 - lo) ** y - (1 - hi) ** y)
    chance *= 2.0**-MANTISSA
    return (same - chance) / (1 - chance)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, parts: int, whole: int) -> np.ndarray:
    """Which pairs (rows of uint16) may share ``parts / whole``: all but those that sizes, differing buckets or, between large sets, the estimate rule out."""
    k, share = a.shape[1], parts / whole
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    # a register unlike the next one is its bucket's own; the other set's own register is another, or it has none
    apart = ((a != b) & ((a != np.roll(a, -1, 1)) | (b != np.roll(b, -1, 1)))).sum(1)
    ok = (whole * small >= parts * large) & ((whole + parts) * apart <= (whole - parts) * (n_a + n_b))
    told = np.flatnonzero(ok & (small > ENOUGH * k))
    if len(told):
        ok[told] = estimate(a[told], b[told], n_a[told], n_b[told]) >= share - ERRORS * (share * (1 - share) / k) ** 0.5
    return ok


def signatures(df: DataFrame, key: str, text: str, words: int, bands: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1``, ``h2`` (hash of the set; of the row if the set is empty), ``bands`` (a long for each), ``mark`` (hash of the text)."""

    def batch(b: pa.RecordBatch) -> dict:
        texts = [(t or "").encode() for t in b.column(1).to_pylist()]
        n, h, regs = [], [], []
        for _, group in w.chunks(texts, CHUNK):
            sets = shingle_sets(group, words)
            n += [len(s) for s in sets]
            with np.errstate(over="ignore"):
                h += [(int(w.scrambled(s).sum(dtype=np.uint64)), int(w.scrambled(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64))) for s in sets]
            some = [i for i, s in enumerate(sets) if len(s)]
            rows = np.zeros((len(group), bands * ROWS), np.uint16)
            if some:
                rows[some] = registers([sets[i] for i in some], bands * ROWS)
            regs.append(rows.view(np.int64))
        flat = np.concatenate(regs)
        hashes = np.array(h, np.uint64).view(np.int64).reshape(-1, 2)
        lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, bands, dtype=np.int32), flat.ravel())
        return {"doc_id": b.column(0), "n_shingles": pa.array(n, pa.int64()), "h1": pa.array(hashes[:, 0]), "h2": pa.array(hashes[:, 1]), "bands": lists, "mark": b.column(2)}

    made = common.arrow_map(df.select(F.col(key).cast("long"), text, F.xxhash64(text).alias("mark")), batch, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, mark long")
    # empty sets get a name of their own, so that they do not meet in one task
    return made.withColumn("h1", F.when(F.col("n_shingles") > 0, F.col("h1")).otherwise(F.xxhash64("doc_id", F.monotonically_increasing_id())))


def full_sets(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``doc_id``, ``h1`` (hash of the set), ``items`` (binary: sorted shingle hashes)."""

    def batch(b: pa.RecordBatch) -> dict:
        out, h = [], []
        for _, group in w.chunks([(t or "").encode() for t in b.column(1).to_pylist()], CHUNK):
            sets = shingle_sets(group, words)
            out += [s.tobytes() for s in sets]
            with np.errstate(over="ignore"):
                h += [int(w.scrambled(s).sum(dtype=np.uint64)) for s in sets]
        return {"doc_id": b.column(0), "h1": pa.array(np.array(h, np.uint64).view(np.int64)), "items": pa.array(out, pa.binary())}

    return common.arrow_map(df.select(F.col(key).cast("long"), text), batch, "doc_id long, h1 long, items binary")


def likely(pairs: DataFrame, signs: DataFrame, parts: int, whole: int) -> DataFrame:
    """Pairs (``a``, ``b``) that may share ``parts / whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(b.num_rows, -1) for c in ("x", "y"))
                ok = may_reach(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), parts, whole)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    left = signs.select(F.col("doc_id").alias("a"), F.col("bands").alias("x"), F.col("n_shingles").alias("n_a"))
    right = signs.select(F.col("doc_id").alias("b"), F.col("bands").alias("y"), F.col("n_shingles").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """Pairs whose full sets meet ``whole * intersection >= parts * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(whole * both >= parts * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("doc_id").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, parts: int = 85, whole: int = 100, bands: int = 20) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and ``mark``, the xxhash64 of its text."""
    docs = common.written(signatures(df, key, text, words, bands), "signatures")
    # one row per distinct set, named by its smallest doc_id
    names = docs.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    names = common.written(names.where("rep is not null"), "sets")
    signs = docs.join(names.select(F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles"), ["doc_id", "h1", "h2", "n_shingles"], "left_semi")
    signs = common.written(signs.dropDuplicates(["doc_id", "h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "bands"), "signs")
    members = signs.select("doc_id", F.posexplode("bands").alias("band", "value"))
    shared = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = common.written(members.join(shared, ["band", "value"]), "buckets")
    taking_part = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    members = members.drop("n")
    sets = common.written(full_sets(df.where(F.col(key).isNotNull()).join(taking_part.select(F.col("doc_id").alias(key)), key, "left_semi"), key, text, words).dropDuplicates(["doc_id", "h1"]).drop("h1"), "full-sets")
    labels = common.written(taking_part.withColumn("root", F.col("doc_id")), "roots")

    def united(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after confirmed links (``a``, ``b``)."""
        links = links.join(labels.select(F.col("doc_id").alias("a"), F.col("root").alias("ra")), "a")
        links = links.join(labels.select(F.col("doc_id").alias("b"), F.col("root").alias("rb")), "b")
        links = common.written(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "links")
        found = graph.components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
        fresh = labels.join(found, "root", "left").select("doc_id", "weight", F.coalesce("to", "root").alias("root"))
        return common.written(fresh, "roots")

    for turn in range(2):
        now = members.join(labels, "doc_id")
        pick = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)) if turn else -F.col("weight"), "doc_id", "root"))
        pivots = now.groupBy("band", "value").agg(pick.alias("p"), F.min("root").alias("low"), F.max("root").alias("high"))
        pivots = pivots.where("low <> high").select("band", "value", F.col("p.doc_id").alias("b"), F.col("p.root").alias("rb"))
        pairs = now.join(pivots, ["band", "value"]).where("root <> rb").select(F.col("doc_id").alias("a"), "b")
        labels = united(labels, confirmed(likely(pairs.distinct(), signs, parts, whole), sets, parts, whole))

    labels = united(labels, across(members.join(labels.drop("weight"), "doc_id"), signs, sets, parts, whole))
    found = docs.join(names, ["h1", "h2", "n_shingles"], "left").join(labels.select(F.col("doc_id").alias("rep"), "root"), "rep", "left")
    root = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), "mark")


GROUP = ("band", "value", "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, and where each group begins, and the end."""
    rest = None
    for b in itertools.chain(batches, [None]):
        tables = [x for x in (rest, b) if x is not None and x.num_rows]
        if not tables:
            continue
        rest, table = None, pa.Table.from_batches(tables).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in GROUP:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        g = np.append(np.flatnonzero(new), table.num_rows)
        if b is not None:  # the last group may go on in the next batch
            rest = table.slice(g[-2]).combine_chunks().to_batches()[0]
            table, g = table.slice(0, g[-2]), g[:-1]
        if len(g) > 1:
            yield table, g


def across(now: DataFrame, signs: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """Links (``a``, ``b``) that join all components which similar members of one bucket have."""
    each = now.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    sizes = each.groupBy("band", "value").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")).where("n > most")
    left = now.join(sizes, ["band", "value"]).join(signs, "doc_id")
    # blocks 0 to ``apart`` - 1 hold what is not in the largest component, the others hold that
    apart, main = (F.ceil(x / BLOCK).cast("int") for x in (F.col("n") - F.col("most"), F.col("most")))
    inside, lot = F.col("root") == F.col("main"), F.xxhash64("doc_id", F.lit(9))
    left = left.withColumns({"own": F.when(inside, apart + F.pmod(lot, main)).otherwise(F.pmod(lot, apart)).cast("int"), "last": F.when(inside, apart - 1).otherwise(apart + main - 1)})
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    left = left.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    n = common.n_partitions(now.sparkSession)

    def may_link(table: pa.Table, g: np.ndarray) -> np.ndarray:
        """Which rows may have a link, in a run of whole groups."""
        t = {c: table.column(c).to_numpy() for c in (*GROUP, "own", "root", "n_shingles")}
        bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        size = np.diff(g)
        first = np.repeat(g[:-1], size * size)
        step = np.arange(len(first)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
        wide = np.repeat(size, size * size)
        x, y = first + step // wide, first + step % wide
        ok = (t["own"][x] == t["i"][x]) & (t["own"][y] == t["j"][y]) & (t["root"][x] != t["root"][y]) & ((t["i"][x] != t["j"][x]) | (x < y))
        x, y = x[ok], y[ok]
        here = np.argmax(bands[x] == bands[y], axis=1) == t["band"][x]
        x, y = x[here], y[here]
        regs = bands.view(np.uint16)
        near = may_reach(regs[x], regs[y], t["n_shingles"][x], t["n_shingles"][y], parts, whole)
        out = np.zeros(table.num_rows, bool)
        out[x[near]] = out[y[near]] = True
        return out

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, g in whole_groups(batches):
            work = np.cumsum(np.diff(g) ** 2)
            cuts = np.unique(np.append(np.searchsorted(work, np.arange(0, work[-1], 200_000), side="right"), len(g) - 1))
            for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                if hi > lo:
                    part = table.slice(g[lo], g[hi] - g[lo]).combine_chunks()
                    some = may_link(part, g[lo : hi + 1] - g[lo])
                    if some.any():
                        yield from part.select([*GROUP, "doc_id", "root"]).filter(pa.array(some)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, g in whole_groups(batches):
            ids, roots, items = table.column("doc_id").to_numpy(), table.column("root").to_numpy(), table.column("items").to_pylist()
            a, b = [], []
            for lo, hi in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
                x, y = forest([np.frombuffer(v, np.uint64) for v in items[lo:hi]], roots[lo:hi], parts, whole)
                a += ids[lo + x].tolist()
                b += ids[lo + y].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = left.select(*GROUP, "own", "doc_id", "root", "n_shingles", "bands").repartition(n, *GROUP).sortWithinPartitions(*GROUP)
    some = dealt.mapInArrow(choose, "band int, value long, i int, j int, doc_id long, root long")
    some = some.join(sets, "doc_id").select(*GROUP, "doc_id", "root", "items").repartition(n, *GROUP).sortWithinPartitions(*GROUP)
    return some.mapInArrow(confirm, "a long, b long")


def forest(sets: list[np.ndarray], roots: np.ndarray, parts: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all links between the sets, as few as join the same sets: each set with the first of its component."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    items, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    several = count[code] > 1  # items of one set only are in no intersection
    column = (np.cumsum(count > 1) - 1)[code[several]]
    row, both = row[several], np.zeros((m, m), np.int64)
    for lo in range(0, int((count > 1).sum()), COLUMNS):
        here = (column >= lo) & (column < lo + COLUMNS)
        held = np.zeros((m, COLUMNS), np.float32)
        held[row[here], column[here] - lo] = 1
        both += (held @ held.T).astype(np.int64)
    linked = whole * both >= parts * (size[:, None] + size[None, :] - both)
    linked |= roots[:, None] == roots[None, :]
    label = np.arange(m)
    while True:
        low = np.where(linked, label[None, :], m).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(m))
    return at, label[at]


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).drop("mark")
