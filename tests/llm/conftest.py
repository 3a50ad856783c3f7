import pytest

#: doc_id, text, lang, source, n_chars and columns whose names the operators use inside.
KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, `range` int, part string, block string, size string, score string, band string, h1 string, id string, "
    "root string, ids string, tail string, kept string, carried string, target string, taken string, words string, `value` string, rank string"
)


def odd_rows():
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, base + "\nsecond line"), (2, base + "\nsecond line"), (3, None), (4, ""), (5, " \t\n "), (6, long), (7, "a"), (8, "A"), (9, base.replace("word7 ", "other ")),
        (10, "Übung macht den Meister ñandú 日本語 " * 5), (11, "the idiot and the moron under the MIT License"), (12, "x" * 400), (13, "x" * 400), (14, "\n\n\n"), (15, base + " tail"),
        (None, base), (2, base + "\nsecond line"), (16, "a<|endoftext|>b 's don't   end\n\n"), (17, long[:5000]), (18, "é" * 49 + " " + base),
    ]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), 1, "p", *["clash"] * 15) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r[:7], *r[7:22]) for r in odd_rows()]
    names = [c.strip() for c in KIND.split(",")]
    return spark.createDataFrame([r + ("clash",) * (len(names) - len(r)) for r in rows], KIND)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
