"""Language identification of mixed-language text.

A text's words are runs of letters (with their combining marks; a run of more
than ``WORD`` letters is cut).  The script of a word's letters, found by code
point ranges, narrows the languages to those that are written in it.  Each
language left gives the word a score, the log-probability of its letter
n-grams.  A Viterbi pass over all words of the text, with a penalty for every
switch of language, labels spans.  Scores are whole numbers (thousandths), so a
path's score does not depend on how the pass is cut into blocks.  The language
with most letters is the text's; its share of the letters is the score.

The Viterbi pass works on many texts at once: texts are cut into blocks of
``STEP`` words, each block's best scores from any language before it to any
language at its end are found side by side, then joined along each text, then
words are labelled inside the blocks.

``fit`` learns from labelled texts: at most ``languages`` languages (the most
frequent ones), at most ``sample`` texts of each (those with the smallest
hashes; a text of one language counts once, however many rows repeat it) and at
most ``grams`` n-grams (the most frequent ones), whatever the corpus.

Null texts and texts without letters have no spans, language ``und`` and score
0; so has every text if nothing was learned.  Words in a script that no learned
language is written in say nothing.  Languages that tie: the first by code point.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

#: Code point ranges of scripts, first and last.
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x0250, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
    (0xFF21, 0xFF5A, "latin"),
    (0x20000, 0x323AF, "han"),
)
STARTS, ENDS = np.array([x[0] for x in SCRIPTS]), np.array([x[1] for x in SCRIPTS])
NAMES = sorted({x[2] for x in SCRIPTS}) + ["other"]
KINDS = np.array([NAMES.index(x[2]) for x in SCRIPTS])
WORD = 40
LETTERS = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{WORD - 1}}}")
#: Bounds of ``fit``; an n-gram counts from ``LEAST`` on, a script from this share of a language's letters on.
LANGUAGES, SAMPLE, GRAMS, LEAST, SHARE = 64, 3_000, 60_000, 3, 0.01
#: In thousandths of a nat: what a word can say against a language at most, what a script says against it, and the penalty of a switch.
CLIP, WRONG, SWITCH = 4_000, 60_000, 9_000
#: Words of a block, blocks side by side, letters of a group of texts, and words that a worker remembers.
STEP, BLOCKS, GROUP, MEMORY = 128, 4_096, 1 << 20, 200_000
LOW = -(1 << 60)


def kinds_of(letters: np.ndarray) -> np.ndarray:
    """The scripts of code points, as places in ``NAMES``."""
    at = np.searchsorted(STARTS, letters, side="right") - 1
    return np.where((at >= 0) & (letters <= ENDS[at]), KINDS[at], len(NAMES) - 1)


@dataclass
class Grams:
    """The n-grams of one to three letters of many words, by the letter they end at (a space stands before and after each word).

    An n-gram is one number, its code points in 21 bits each; 0 where there is none.
    """

    word: np.ndarray
    by_size: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: the script of most letters of each word; of equals, the first in ``NAMES``
    kind: np.ndarray

    @classmethod
    def of(cls, found: list[str]) -> Grams:
        flat = " " + " ".join(found) + " "
        c = np.frombuffer((flat if flat.isascii() else unicodedata.normalize("NFC", flat)).lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        space = c == 32
        word = np.cumsum(space) - 1 - space
        two, three = c.copy(), c.copy()
        two[1:] |= c[:-1] << 21
        three[2:] |= c[:-2] << 42 | c[1:-1] << 21
        three[1:][space[:-1]] = 0
        letter = ~space
        kinds, own = kinds_of(c[letter]), word[letter]
        first = np.searchsorted(own, np.arange(len(found)))
        low, high = (f.reduceat(kinds, first) for f in (np.minimum, np.maximum))
        for i in np.flatnonzero(low != high):  # marks are of no script
            x = np.array([ord(y) for y in found[i] if y.isalpha()])
            low[i] = np.bincount(kinds_of(x)).argmax()
        return cls(word[1:], (c[1:], two[1:], three[1:]), low)


@dataclass
class Model:
    """What was learned; ``grams`` are sorted n-grams, ``logs`` their log-probabilities in each language, in thousandths."""

    languages: list[str] = field(default_factory=list)
    prior: list[int] = field(default_factory=list)
    scripts: list[frozenset[str]] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    switch: int = SWITCH

    def scores(self, found: list[str]) -> np.ndarray:
        """Each word's scores for all languages, 0 for the best one.

        At each letter the longest known n-gram that ends there counts.
        """
        k = len(self.languages)
        if not found:
            return np.zeros((0, k), np.int64)
        g = Grams.of(found)
        known = np.concatenate((self.logs, np.zeros((1, k), np.int64)))
        row = np.full(len(g.word), len(self.grams))
        for codes in g.by_size:  # longer ones replace shorter ones
            at = np.minimum(np.searchsorted(self.grams, codes), max(0, len(self.grams) - 1))
            row = np.where(self.grams[at] == codes, at, row) if len(self.grams) else row
        total = np.add.reduceat(known[row], np.searchsorted(g.word, np.arange(len(found))))
        fits = np.array([[name in s for s in self.scripts] for name in NAMES])[g.kind]
        top = np.where(fits, total, LOW).max(axis=1, keepdims=True)
        return np.where(fits, np.maximum(total - top, -CLIP), np.where(fits.any(axis=1, keepdims=True), -WRONG, 0))


class Labeller:
    """Labels words of many texts; remembers words up to ``MEMORY``."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.int64)
        self.letters = np.zeros(0, np.int64)

    def numbers(self, found: list[str]) -> np.ndarray:
        """Rows of ``table`` for the words."""
        new = set(found) - self.index.keys()
        if new and len(self.index) + len(new) > MEMORY:
            self.index, self.table, self.letters, new = {}, self.table[:0], self.letters[:0], set(found)
        if new:
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.model.scores(list(new))))
            self.letters = np.concatenate((self.letters, np.fromiter(map(len, new), np.int64, len(new))))
        return np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))

    def transfers(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best scores of blocks (longest first) from each language before to each language at the end: blocks x k x k."""
        k = self.table.shape[1]
        best = np.full((len(ids), k, k), LOW)
        best[:, np.arange(k), np.arange(k)] = 0
        for t in range(sizes.max(initial=0)):
            n = np.searchsorted(-sizes, -t)
            m = best[:n]
            np.maximum(m, m.max(axis=2, keepdims=True) - self.model.switch, out=m)
            m += self.table[ids[:n, t]][:, None, :]
        return best

    def inside(self, ids: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Languages of the words of blocks (longest first) between a language before and one at the end."""
        n_blocks, k = len(ids), self.table.shape[1]
        value = np.full((n_blocks, k), LOW)
        value[np.arange(n_blocks), start] = 0
        jumped, source = np.zeros((ids.shape[1], n_blocks, k), bool), np.zeros((ids.shape[1], n_blocks), np.int16)
        for t in range(sizes.max(initial=0)):
            n = np.searchsorted(-sizes, -t)
            v = value[:n]
            top = v.argmax(axis=1)
            jump = v[np.arange(n), top][:, None] - self.model.switch
            jumped[t, :n], source[t, :n] = jump > v, top
            np.maximum(v, jump, out=v)
            v += self.table[ids[:n, t]]
        labels, state = np.zeros(ids.shape, np.int16), end.astype(np.int16)
        for t in range(sizes.max(initial=0) - 1, -1, -1):
            n = np.searchsorted(-sizes, -t)
            s = state[:n]
            labels[:n, t] = s
            state[:n] = np.where(jumped[t, np.arange(n), s], source[t, :n], s)
        return labels

    def labels(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its text; ``counts``: words of each text, whose ``ids`` follow each other."""
        k = self.table.shape[1]
        n_blocks = -(-counts // STEP)
        first = np.cumsum(n_blocks) - n_blocks
        text = np.repeat(np.arange(len(counts)), n_blocks)
        turn = np.arange(len(text)) - first[text]
        begin = (np.cumsum(counts) - counts)[text] + turn * STEP
        size = np.minimum(STEP, counts[text] - turn * STEP)
        place = np.minimum(begin[:, None] + np.arange(STEP), len(ids) - 1)
        order = np.argsort(-size, kind="stable")
        move = np.zeros((len(text), k, k), np.int64)
        for i in range(0, len(order), BLOCKS):
            at = order[i : i + BLOCKS]
            move[at] = self.transfers(ids[place[at]], size[at])
        value = np.tile(np.array(self.model.prior, np.int64), (len(counts), 1))
        came = np.zeros((len(text), k), np.int16)
        for t in range(n_blocks.max(initial=0)):
            there = np.flatnonzero(n_blocks > t)
            ways = value[there][:, :, None] + move[first[there] + t]
            came[first[there] + t] = ways.argmax(axis=1)
            value[there] = ways.max(axis=1)
        state = value.argmax(axis=1)
        start, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for t in range(n_blocks.max(initial=0) - 1, -1, -1):
            there = np.flatnonzero(n_blocks > t)
            end[first[there] + t] = state[there]
            state[there] = start[first[there] + t] = came[first[there] + t, state[there]]
        out = np.zeros(len(ids), np.int16)
        for i in range(0, len(order), BLOCKS):
            at = order[i : i + BLOCKS]
            there = np.arange(STEP) < size[at][:, None]
            out[place[at][there]] = self.inside(ids[place[at]], size[at], start[at], end[at])[there]
        return out

    def spans(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, str]], str, float]]:
        """For each text its spans (from and to, in code points, and language), its language and score."""
        languages = self.model.languages
        for _, group in words.chunks([t or "" for t in texts], GROUP):
            found = [LETTERS.findall(t) if languages else [] for t in group]
            counts = np.array([len(f) for f in found])
            ids = self.numbers([w for f in found for w in f])
            labels = self.labels(ids, counts) if len(ids) else np.zeros(0, np.int16)
            text = np.repeat(np.arange(len(group)), counts)
            k = max(1, len(languages))
            letters = np.bincount(text * k + labels, weights=self.letters[ids], minlength=len(group) * k).reshape(len(group), k)
            at = 0
            for i, t in enumerate(group):
                own, at = labels[at : at + counts[i]], at + counts[i]
                if not len(own):
                    yield [], "und", 0.0
                    continue
                turn = np.flatnonzero(np.diff(own)) + 1
                cut = [0, len(t)]
                if len(turn):
                    starts = [m.start() for m in LETTERS.finditer(t)]
                    cut[1:1] = [starts[j] for j in turn]
                best = int(letters[i].argmax())
                yield [(a, b, languages[own[j]]) for a, b, j in zip(cut[:-1], cut[1:], [0, *turn], strict=True)], languages[best], float(letters[i, best] / letters[i].sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", languages: int = LANGUAGES, sample: int = SAMPLE, limit: int = GRAMS, switch: int = SWITCH) -> Model:
    """Learns languages from the rows of ``docs`` with text and language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.shiftrightunsigned(F.xxhash64(text), 11).alias("h")).where("text is not null and lang is not null")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not known:
        return Model()
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * sample / r["count"])) for r in known], "lang string, share double")
    # texts far above the sample's hashes are left out before any text is shuffled
    near = rows.join(F.broadcast(share), "lang").where(F.col("h") <= F.col("share") * float(1 << 53))
    first = Window.partitionBy("lang").orderBy("h", "text")
    near = near.groupBy("lang", "text").agg(F.min("h").alias("h")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    near = common.written(near.select("lang", "text"), "languages-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[str, Counter] = {}
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(name, Counter()).update(LETTERS.findall(x))
            for name, seen in own.items():
                if not seen:
                    continue
                g, times = Grams.of(list(seen)), np.fromiter(seen.values(), np.int64)
                every = np.concatenate([x.astype(np.int64) for x in g.by_size])
                codes, place = np.unique(every, return_inverse=True)
                n = np.bincount(place, weights=np.tile(times[g.word], 3)).astype(np.int64)
                letters = np.bincount(g.kind, weights=times * np.fromiter(map(len, seen), np.int64), minlength=len(NAMES)).astype(np.int64)
                keep, codes = codes > 0, np.concatenate((codes, -1 - np.arange(len(NAMES))))  # scripts count as numbers below 0
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * (keep.sum() + len(NAMES)), pa.string()), "gram": pa.array(np.concatenate((codes[: len(keep)][keep], codes[len(keep) :]))), "n": pa.array(np.concatenate((n[keep], letters)))})

    counts = common.written(near.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 0"), "languages-grams")
    # the most frequent n-grams, and each language's numbers of them: ``limit`` times ``languages`` numbers at most
    total = counts.where("gram > 0").groupBy("gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    picked = total.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "gram").limit(limit).select("gram", "by").collect()
    size_of = F.when(F.col("gram") >= 1 << 42, 3).when(F.col("gram") >= 1 << 21, 2).otherwise(1)
    sums = {(r["lang"], r["size"]): r["n"] for r in counts.where("gram > 0").groupBy("lang", size_of.alias("size")).agg(F.sum("n").alias("n")).collect()}
    letters: dict[str, dict[str, int]] = {r["lang"]: {} for r in known}
    for r in counts.where("gram < 0").collect():
        letters[r["lang"]][NAMES[-1 - r["gram"]]] = r["n"]
    common.delete(near)
    common.delete(counts)
    names = sorted(letters)
    rows_of = {r["lang"]: r["count"] for r in known}
    picked.sort(key=lambda r: r["gram"])
    grams = np.array([r["gram"] for r in picked], np.int64)
    size = 1 + (grams >= 1 << 21) + (grams >= 1 << 42)
    found = np.array([[r["by"].get(x, 0) for x in names] for r in picked], float).reshape(len(grams), len(names))
    whole = np.array([[sums.get((x, n), 0) + 0.5 * (size == n).sum() for x in names] for n in (1, 2, 3)])
    logs = np.rint(1000 * np.log((found + 0.5) / np.maximum(1, whole[size - 1]))).astype(np.int64)
    prior = [round(1000 * math.log(rows_of[x] / sum(rows_of.values()))) for x in names]
    scripts = [frozenset(k for k, n in letters[x].items() if n >= SHARE * sum(letters[x].values())) for x in names]
    return Model(names, prior, scripts, grams, logs, switch)


SPANS = "spans array<struct<from: int, to: int, lang: string>>, lang_pred string, score double"


def label(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``spans``, ``lang_pred`` and ``score`` of each row's whole text."""
    kind = dict(df.dtypes)[key]
    made: dict[int, Labeller] = {}
    struct = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())])

    def batch(b: pa.RecordBatch) -> dict:
        if not made:
            made[0] = Labeller(model)
        got = list(made[0].spans(b.column(1).to_pylist()))
        spans = pa.array([[{"from": a, "to": z, "lang": x} for a, z, x in s] for s, _, _ in got], pa.list_(struct))
        return {key: b.column(0), "spans": spans, "lang_pred": pa.array([g[1] for g in got], pa.string()), "score": pa.array([g[2] for g in got], pa.float64())}

    return common.arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), batch, f"`{key}` {kind}, {SPANS}", made.clear)


def held_out(key: str = "doc_id"):
    """Rows whose text nothing is learned from; rows without id are not held out, and nothing is learned from them either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = label(docs.select("doc_id", "text"), fitted(docs))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
