"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs to Latin letters, digits and
signs inside words to the letters they stand for.  Lexicon entries are words
and beginnings of words; one automaton finds them all.  A word counts once,
with its heaviest entry, unless an exception phrase covers it.  The sum of
weights and the sum normalised by length give the score through a logistic
function.

``fit`` learns entries and weights from labelled texts.  A text counts once for
each label that any of its rows has, however many rows repeat it.  It uses a
bounded sample, at most ``sample`` of these, those with the smallest hashes of
their texts.  The lexicon has at most ``entries`` entries, whatever the corpus.

Null and empty texts have no words; their score is that of a text with no hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters that look like Latin ones, and what digits and signs inside words stand for.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏαεορτυνκιꜱɡ０１２３４５７＠＄", "aeopcyxijsdhlaeoptuvkisg0123457@$")
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457@$](?=[^\W\d_]{2})")
HIDDEN = re.compile("[­​-‍⁠﻿]")
WORD = re.compile(r"[^\W\d_]+")
#: Harmless phrases that hold lexicon words.
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "idiot proof", "sore loser", "loser bracket", "scum line", "pond scum")
#: Bounds of ``fit``: labelled texts used, lexicon entries, and the shortest and longest beginning of a word.
SAMPLE, ENTRIES, SHORT, LONG = 20_000, 4_000, 3, 9
#: An entry stands in at least this many toxic texts, and its log odds and log-likelihood ratio are at least these.
LEAST, ODDS, SURE = 5, 2.0, 26.0


def folded(text: str | None) -> list[str]:
    """The folded words of a text."""
    if not text:
        return []
    x = text.lower()
    if not x.isascii():
        x = HIDDEN.sub("", x.translate(LOOKALIKES))
    if INSIDE.search(x):
        x = INSIDE.sub(lambda m: "".join(STANDS_FOR[c] for c in m[0]), x)
    return WORD.findall(x)


def entries_of(word: str) -> Iterator[str]:
    """What may be in the lexicon for a word: " word " whole, " wor" its beginnings."""
    yield f" {word} "
    for k in range(SHORT, min(LONG, len(word)) + 1):
        yield f" {word[:k]}"


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: intercept, of the log of one plus the weights' sum, of the sum a word
    line: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def __post_init__(self):
        self.found = None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def automaton(self):
        if self.found is None:
            import ahocorasick

            self.found = ahocorasick.Automaton()
            for e in self.exceptions:
                self.found.add_word(f" {e} ", (len(e) + 2, 0.0, True))
            for e, w in self.weights.items():
                if not self.found.exists(e):
                    self.found.add_word(e, (len(e), w, False))
            self.found.make_automaton()
        return self.found

    def weigh(self, text: str | None) -> tuple[float, int]:
        """The sum of a text's weights and its number of words."""
        words = folded(text)
        automaton = self.automaton()
        if not words or not len(automaton):
            return 0.0, len(words)
        flat = " " + " ".join(words) + " "
        at: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, harmless) in automaton.iter(flat):
            start = end - size + 1
            if harmless:
                excused.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
        return sum(at.values()) if not excused else sum_outside(at, excused), len(words)

    def score(self, text: str | None) -> float:
        return self.of(*self.weigh(text))

    def of(self, total: float, words: int) -> float:
        a, b, c = self.line
        z = a + b * math.log1p(total) + c * total / (20 + words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sum_outside(at: dict[int, float], excused: list[tuple[int, int]]) -> float:
    """The sum of weights at places that no span holds; both are walked once, in order."""
    spans = iter(sorted(excused))
    span, reach, total = next(spans, None), -1, 0.0
    for place in sorted(at):
        while span is not None and span[0] <= place:
            reach, span = max(reach, span[1]), next(spans, None)
        if place >= reach:
            total += at[place]
    return total


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> Lexicon:
    """Learns a lexicon from the rows of ``docs`` that ``labels`` gives 0 or 1; null texts and labels are left out.

    Before the labels are joined, rows whose hash is far above those of the
    sample are left out, so that few texts are shuffled; then the ``sample``
    smallest hashes of distinct texts and labels stay (a number each on the driver).
    """
    known = labels.select(key, F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    share = min(1.0, 2 * sample / max(1, known.count()))
    rows = docs.select(key, F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(text), 11).alias("h")).where(F.col("text").isNotNull())
    if share < 1:
        rows = rows.where(F.col("h") <= int(share * (1 << 53)))
    rows = rows.join(known, key).groupBy("text", "y").agg(F.min("h").alias("h"))
    rows = common.written(rows, "toxicity-sample")
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y > 0].update({e for w in set(folded(x)) for e in entries_of(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()), "bad": pa.array([seen[1][k] for k in keys], pa.int64()), "good": pa.array([seen[0][k] for k in keys], pa.int64())})

    n_good, n_bad = (rows.agg(F.coalesce(F.sum(1 - F.col("y")), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())[0:2]
    if not n_good or not n_bad:
        return Lexicon()
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    n, seen = float(n_good + n_bad), F.col("bad") + F.col("good")

    def term(found, expected):
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    sure = 2 * (
        term(F.col("bad"), seen * n_bad / n) + term(F.col("good"), seen * n_good / n)
        + term(n_bad - F.col("bad"), (n - seen) * n_bad / n) + term(n_good - F.col("good"), (n - seen) * n_good / n)
    )
    counts = rows.mapInArrow(count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    picked = counts.where(F.col("bad") >= LEAST).select("entry", "bad", "good", odds.alias("odds"), sure.alias("sure")).where(f"odds >= {ODDS} and sure >= {SURE}")
    found = {r["entry"]: (r["bad"], r["odds"]) for r in picked.orderBy(F.desc("sure"), "entry").limit(entries).collect()}
    lexicon = Lexicon(specific(found))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.weigh(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"total": pa.array([g[0] for g in got], pa.float64()), "words": pa.array([g[1] for g in got], pa.int64()), "y": b.column(1)})

    # ``sample`` rows of three numbers; two texts of one hash may add one more
    seen = rows.mapInArrow(weigh, "total double, words long, y int").toPandas()
    lexicon.line = logistic(seen["total"].to_numpy(), seen["words"].to_numpy(), seen["y"].to_numpy())
    return lexicon


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights without entries that say what another says.

    A beginning that is nearly always continued in one way goes, its longest
    continuation stays (the whole word only if it is short, so that inflected
    forms of long words are found).  A continuation goes if a beginning that
    stays weighs as much.
    """
    keep = dict(found)
    for e, (bad, _) in found.items():
        longer = [x for x in found if x != e and x.startswith(e) and found[x][0] >= 0.95 * bad]
        if longer and not (longer == [f"{e} "] and len(e) > 5):
            keep.pop(e)
        elif longer:
            keep.pop(longer[0])
    return {e: w for e, (_, w) in keep.items() if not any(keep.get(e[:k], (0, -1.0))[1] >= w for k in range(SHORT + 1, len(e)))}


def logistic(total: np.ndarray, words: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method on two features and an intercept."""
    x = np.column_stack([np.ones(len(y)), np.log1p(total), total / (20 + words)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with one more column, the score of each text; a column of that name is replaced."""
    return common.with_made(df, text, into, "double", lambda texts: pa.array([lexicon.score(x) for x in texts], pa.float64()))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return fit(docs, labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
