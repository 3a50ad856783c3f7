import os

import duckdb
import pytest

from tidalbook.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "https://a.example.org/es/x?q#f", "https://example.org/en/12", "https://xexample.org/en/12", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com/de/?a=/", "http://x.com?y=/de/", "http://x.com#/fr/", "ftp://org/", "http://org/a", "http://cheap-pills.example.com/en/1/", "http://www.cheap-pills.example.com/en/1",
    "http://cheap-pills.example.com/fr/1", "a://b://c/d", "http://h\n.net/p\nq", "http://ÀB.net/É", "http://cheap-pills.example.com/en/1/",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_by_hand(spark):
    """The list comes from contents: pages with a listed canonical URL go, other pages of the same host stay."""
    junk = "a*** b### c%%% d$$$ e***"
    html = {15: junk, 21: "", 17: junk, 19: junk + "\n" + junk, 3: junk, 5: junk, 22: None, 24: "a*** b###"}
    more = ["http://cheap-pills.example.com/other", "http://m.cheap-pills.example.com/fr/1//?x", "http://q.net/", "http://q.net/x\n", "http://q.net/x/\n", "http://q.net/x"]
    every = URLS + more
    html[len(URLS) + 3] = junk
    rows = [(i, u, html.get(i, "clean"), "c") for i, u in enumerate(every)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, canonical string")
    listed = urls.block_list(pages)
    got = {r["page_id"]: r for r in urls.judge(pages, listed).collect()}

    def canon(u):
        host, path, _ = by_hand(u)
        return host.removeprefix("www.").removeprefix("m.") + path.rstrip("/") if host else None

    names = {canon(every[i]) for i, h in html.items() if h and h.count("***") + h.count("###") + h.count("%%%") + h.count("$$$") >= 5} - {None}
    assert {r["canonical"] for r in listed.collect()} == names and "q.net/x\n" in names and len(got) == len(every)
    for i, u in enumerate(every):
        host, path, rule = by_hand(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0] + rule[1]), u
        assert r["verdict"] == (rule[2] if rule else "block" if canon(u) in names else "allow"), u
    assert got[16]["verdict"] == "block" and got[len(URLS)]["verdict"] == "allow" and got[len(URLS) + 5]["verdict"] == "allow"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(none, urls.block_list(none)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(one, urls.block_list(none)).collect()] == ["allow", "allow"]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('u', id) as canonical")
    asked = spark.range(20000).selectExpr("concat('u', id) as canonical")
    assert urls.listed_among(asked, listed).count() == 3000
    blocks = 3000 * urls.BITS // 512
    tried = asked.withColumn("block", urls._block("canonical", blocks)).join(urls.bloom(listed, blocks), "block")
    for i, b in enumerate(urls._bits("canonical")):
        tried = tried.where(b.bitwiseAND(urls.F.col(f"w{i}")) != 0)
    assert 3000 <= tried.count() < 3000 + 17000 * 0.02


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{os.path.join(sf_dir, 'pages.parquet')}'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, urls.op5_urls(spark, sf_dir).select(cols).collect()))) == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({urls.oracle()})").fetchall()))
