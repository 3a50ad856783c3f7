import random
import unicodedata
import zlib

import numpy as np
import pytest

from tidalbook.llm import languages as lang

WORDS = {"aa": ["kana", "kato", "kan", "toka", "nako"], "bb": ["zibi", "zub", "bizu", "zubi", "ibuz"], "cc": ["ката", "кано", "тока", "нока"]}


def made(rng, name, n):
    return " ".join(rng.choice(WORDS[name]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, name, 30), name) for i in range(120) for name in WORDS]
    return lang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain_scores(model, word):
    """One word at a time, with a dict of n-grams."""
    logs = {tuple(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s): row for g, row in zip(model.grams, model.logs.tolist(), strict=True)}
    kinds = [lang.NAMES[k] for k in lang.kinds_of(np.array([ord(c) for c in word if c.isalpha()]))]
    kind = max(lang.NAMES, key=lambda k: (kinds.count(k), -lang.NAMES.index(k)))
    fits = [kind in s for s in model.scripts]
    if not any(fits):
        return [0] * len(fits)
    w = " " + unicodedata.normalize("NFC", word).lower() + " "
    total = [0] * len(fits)
    for end in range(2, len(w) + 1):
        for n in (3, 2, 1):
            got = logs.get(tuple(w[max(0, end - n) : end]))
            if got:
                total = [a + b for a, b in zip(total, got, strict=True)]
                break
    top = max(t for t, f in zip(total, fits, strict=True) if f)
    return [max(-lang.CLIP, t - top) if f else -lang.WRONG for t, f in zip(total, fits, strict=True)]


def best_path(model, words):
    """The best path's score, by the plain recursion."""
    value = list(model.prior)
    for w in words:
        top = max(value) - model.switch
        value = [max(v, top) + s for v, s in zip(value, plain_scores(model, w), strict=True)]
    return max(value)


def path_score(model, words, labels):
    """The best score of a path with these labels; the language before the first word is free."""
    score = max(p - (i != labels[0]) * model.switch for i, p in enumerate(model.prior))
    for i, (w, x) in enumerate(zip(words, labels, strict=True)):
        score += plain_scores(model, w)[x] - (i > 0 and labels[i - 1] != x) * model.switch
    return score


def test_word_scores(model):
    words = ["kana", "Zub", "ката", "x", "kanaката", "日本", "é", "éá", "zibizibizibi", "İstanbul", "ΣΑΣ"]
    assert model.scores(words).tolist() == [plain_scores(model, w) for w in words]
    assert model.scores([]).shape == (0, 3)


@pytest.mark.parametrize("step", [1, 3, 128])
def test_best_paths(model, step, monkeypatch):
    monkeypatch.setattr(lang, "STEP", step)
    monkeypatch.setattr(lang, "BLOCKS", 5)
    rng = random.Random(step)
    texts = [" ".join(made(rng, rng.choice(list(WORDS)), rng.randrange(1, 9)) for _ in range(rng.randrange(0, 7))) for _ in range(40)]
    words = [lang.LETTERS.findall(t) for t in texts]
    labeller = lang.Labeller(model)
    labels = labeller.labels(labeller.numbers([w for x in words for w in x]), np.array([len(x) for x in words]))
    at = 0
    for own in words:
        if own:
            assert path_score(model, own, labels[at : at + len(own)].tolist()) == best_path(model, own)
        at += len(own)
    assert at == len(labels)


def test_spans_of_mixed_text(model, spark):
    rng = random.Random(3)
    parts = [made(rng, "aa", 30), made(rng, "bb", 12), made(rng, "cc", 9)]
    text = "123 " + parts[0] + ". " + parts[1] + "! " + parts[2] + " 日本"
    (row,) = lang.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [s["lang"] for s in row["spans"]] == ["aa", "bb", "cc"] and row["lang_pred"] == "aa" and 0.5 < row["score"] < 0.8
    assert [text[s["from"] : s["to"]] for s in row["spans"]] == ["123 " + parts[0] + ". ", parts[1] + "! ", parts[2] + " 日本"]
    one = list(lang.Labeller(model).spans([parts[0] + " zub " + parts[0]]))[0]
    assert [s[2] for s in one[0]] == ["aa"]  # one word does not pay for two switches


def test_memory_is_bounded(model, monkeypatch):
    texts = [made(random.Random(i), "aa", 5) + f" kan{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(50)]
    want = list(lang.Labeller(model).spans(texts))
    monkeypatch.setattr(lang, "MEMORY", 8)
    monkeypatch.setattr(lang, "GROUP", 60)
    assert list(lang.Labeller(model).spans(texts)) == want


def test_odd_rows(model, odd, nothing, spark):
    got = lang.label(odd, model).collect()
    assert len(got) == odd.count() and nothing.count() == lang.label(nothing, model).count() == 0
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not r["spans"])
    odd_texts = [None, "", " \n", "12 ½ ²", "_", "a", "x" * 5000, "ª", "\U00020000"]
    rows = lang.label(spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in rows] == [True] * 5 + [False] * 4
    assert [r["score"] for r in rows[:5]] == [0.0] * 5


def test_nothing_to_learn_from(spark, odd, nothing):
    for docs in (nothing, odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang <> ''"), odd.where("text is null")):
        none = lang.fit(docs)
        assert none.languages == []
        assert {r["lang_pred"] for r in lang.label(odd, none).collect()} == {"und"}
    letterless = lang.fit(spark.createDataFrame([(1, "1 2", "xx"), (2, "", "yy")], "doc_id long, text string, lang string"))
    assert letterless.languages == ["xx", "yy"]
    assert {r["lang_pred"] for r in lang.label(odd, letterless).collect()} == {"und", "xx"}  # all say nothing: the first


def test_bounds_of_the_sample(spark):
    rows = [(i, f"kan{'abcdefghij'[i % 10]} {'z' * (i % 50 + 1)}", "hot" if i % 3 else f"l{i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = lang.fit(df, languages=3, sample=4, limit=20)
    assert len(small.languages) == 3 and "hot" in small.languages and len(small.grams) <= 20
    assert len(lang.fit(df).languages) == 8


def test_query(spark):
    """Whole table, held-out accuracy, labels of the text only."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = lang.op12_languages(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 250 and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out]) > 0.985


def test_held_out_rows_teach_nothing(spark):
    """Other languages on held-out rows change no prediction."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    twisted = docs.withColumn("lang", F.when(lang.held_out(), "zz").otherwise(F.col("lang")))
    a, b = lang.fitted(docs), lang.fitted(twisted)
    assert a.languages == b.languages and (a.grams == b.grams).all() and (a.logs == b.logs).all()
