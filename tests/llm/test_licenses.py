import random
import re

from tidalbook.llm import licenses as lic

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    """Base places by comparing word lists, template labels by counting every block against every template."""
    w = words(text)
    places, base = [], set()
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if base else 0.0
    cut = lambda x, n: [x] if len(x) <= n else [x[i : i + n] for i in range(0, len(x) - n // 2, n // 2)]
    for t, label in lic.TEMPLATES.items():
        whole, n = set(t.split()), lic.BLOCK
        while n < 2 * len(t.split()):
            n *= 2
        blocks = cut(w, n) + [b for line in (text or "").split("\n") * (n == lic.BLOCK) for b in cut(words(line), n)]
        for b in blocks:
            m = len(t.split())
            near = [b[i : i + m + max(1, m // 5)] for i in range(len(b))] if m <= lic.BLOCK // 2 else [b]
            share = max((len(whole & set(x)) for x in near), default=0) / len(whole)
            if share >= lic.THRESHOLD - 1e-12:
                labels.add(label)
                score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "under the mit\nlicense", "under the mit license under the mit license", "UNDER-THE-MIT-LICENSE", "under the mít license",
    "cc by nc cc by nc by nc", "CC-BY-NC 4.0", "Licensed under the Apache License, Version 2.0.", "Apache License, Version 2", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the GNU General Public License, version 2", "x " * 100 + "version 3 of the license public general gnu under licensed" + " y" * 100, "all rights are reserved", "ALL RIGHTS RESERVED", "nc\x00by cc by nc\x7f",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
]


def test_against_brute_force(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in lic.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_texts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lic.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t
    assert got[13][5] == "gpl-2" and got[12][5] == "gpl-3" and got[8][1] == 2


def test_odd_rows_and_empty_table(odd, nothing):
    got = sorted(str(tuple(r)) for r in lic.scan(odd).collect())
    assert got == sorted(str((r["doc_id"], *brute(r["text"]))) for r in odd.collect())
    assert lic.scan(nothing).count() == 0


def test_no_templates(spark):
    df = spark.createDataFrame([(1, "under the mit license")], "doc_id long, text string")
    assert lic.scan(df, templates={}).first()["labels"] == "mit"


def test_whole_notices(spark):
    """Every template, wrapped anywhere and deep in a text, and with a tenth of its words changed; not with a fifth of them gone."""
    rng, texts, want = random.Random(3), [], []
    around = [f"w{i}" for i in range(700)]
    for t, label in lic.TEMPLATES.items():
        own = t.split()
        at = rng.randrange(600)
        texts.append("\n".join(" ".join((around[:at] + own + around[at:])[i : i + 9]) for i in range(0, 700 + len(own), 9)))
        want.append(label)
        if len(own) > 40:
            few = sorted(set(own), key=lambda w: rng.random())
            texts += [" ".join(f"x{w}" if w in few[: k * len(few) // 20] else w for w in own) for k in (1, 5)]
            want += [label, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lic.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
        assert want[i] is None or want[i] in got[i][5].split(",")


def test_ordinary_sentences_are_no_notices(spark):
    sentences = [
        "The hotel reserved all twelve rooms and waived the usual rights of the guests.", "GNU General Public License version 3, see section 2 of it", "Licensed under the GNU General Public License version 3, see section 2 of it",
        "This work moves the public: it is dedicated to every domain of the town, and to the free one.", "All who paid have reserved their seats; other rights are not affected.",
    ]
    df = spark.createDataFrame(list(enumerate(sentences)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lic.scan(df).collect()}
    assert [got[i][5] for i in range(len(sentences))] == ["", "", "gpl-3", "", ""]
    assert all(got[i] == brute(t) for i, t in enumerate(sentences))


def test_many_places():
    index = lic.Index({}, lic.BASE, {}, 0.9)
    text = "under the mit license and " * 60_000
    assert index.scan(text)[:4] == (300_000, 60_000, 0, 299_995)


def test_needed():
    assert [lic.needed(n, 0.9) for n in (1, 3, 5, 9, 10, 20)] == [1, 3, 5, 9, 9, 18]


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
APACHE = "// Licensed under the Apache License,{0}// Version 2.0 (the License)"


def test_wrapped_notices(spark):
    ahead, behind = "\n".join(["some words of code"] * 90) + "\n", "\n\nand other words" * 50
    texts = [MIT, BSD, ahead + MIT + behind, BSD.replace("\n", "\r\n * "), APACHE.format("\n"), APACHE.format("\r"), "all\nrights\nreserved", "all\n" + "x\n" * 80 + "rights\nreserved", *("y\n" * k + BSD for k in range(0, 130, 9))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in lic.scan(df).collect()}
    bsd = ("bsd", 1.0)
    assert [got[i] for i in range(8)] == [("mit", 1.0), bsd, ("mit", 1.0), bsd, ("apache-2", 1.0), ("apache-2", 1.0), ("all-rights-reserved", 1.0), ("", 0.0)]
    assert all(got[i] == bsd for i in range(8, len(texts)))
