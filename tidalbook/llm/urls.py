"""URL filter: host and path rules, then a listed-URL test through a blocked Bloom filter.

A rule (host, path) fits its host and all subdomains of it if the URL's path
starts with the rule's path; the longest fitting rule decides.  URLs that no
rule fits are looked up in a list of canonical URLs, any table of them.  The
query lists the pages whose contents are junk, whatever their URLs are; other
pages of the same hosts pass.  The list's hashes fill a
blocked Bloom filter: a hash picks one block of eight 64-bit words and one bit
in each.  The filter is a table of blocks, so Spark broadcasts it under its own
size threshold and otherwise shuffles both sides by block.  Only URLs that pass
go to the exact hash join with the list, which removes false positives.

Hosts: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; paths: from there up to ``?``, ``#`` or the end.  Null URLs and
URLs without ``://`` have an empty host and path, fit no rule and are never
listed.  Repeated rows each get their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Marks of junk in a page, and how many of them put it on the list.
JUNK, LEAST = r"[*]{3}|#{3}|%{3}|[$]{3}", 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter per listed URL; words per block.
BITS, WORDS = 16, 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest comes last and so stands outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without trailing slashes; null if there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+\z", "")))


def _bits(url: str) -> list[Column]:
    h = F.xxhash64(F.lit(1), F.col(url))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63))).cast("int")) for i in range(WORDS)]


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), F.col(url)), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """The filter: ``block`` and eight words."""
    bits = listed.select(_block(url, blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(url))))
    return bits.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_among(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """The distinct values of ``urls`` that ``listed`` holds: the filter first, then the exact join."""
    blocks = max(1, -(-listed.count() * BITS // (64 * WORDS)))
    seen = urls.select(url).where(F.col(url).isNotNull()).distinct()
    tried = seen.withColumn("block", _block(url, blocks)).join(bloom(listed, blocks, url), "block")
    for i, b in enumerate(_bits(url)):
        tried = tried.where(b.bitwiseAND(F.col(f"w{i}")) != 0)
    return tried.select(url).join(listed, url, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``; ``listed`` has distinct ``canonical`` URLs to block."""
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    told = parts.withColumns({"rule": rule, "verdict": verdict})
    told = told.withColumn("canonical", F.when(F.col("rule").isNull(), canonical(F.col("host"), F.col("path"))))
    hits = listed_among(told, listed).withColumn("listed", F.lit(True))
    # rows that a rule decides get a key of their own that matches nothing, else all would meet in one task
    join_on = F.coalesce("canonical", F.concat(F.lit("//"), F.xxhash64(key, "host", "path").cast("string")))
    joined = told.withColumn("canonical", join_on).join(hits, "canonical", "left")
    return joined.select(key, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def block_list(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct canonical URLs of pages whose contents are junk; a null page is none."""
    bad = pages.where(F.regexp_count(F.col(html), F.lit(JUNK)) >= LEAST)
    return bad.select(canonical(host_of(F.col(url)), path_of(F.col(url))).alias("canonical")).where("canonical is not null").distinct()


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    listed = common.written(block_list(pages), "url-list")
    return judge(pages.select("page_id", "url"), listed)


def oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in order)
    return f"""
with parts as (
  select page_id, html,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
named as (select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+\\z', '') as canonical from parts),
listed as (select distinct canonical from named where host <> '' and len(regexp_extract_all(html, '{JUNK}')) >= {LEAST})
select page_id, host, path, case {rule} end as rule,
       case {verdict} when host <> '' and canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from named"""
