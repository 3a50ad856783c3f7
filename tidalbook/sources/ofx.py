"""Statement files (OFX and QFX) as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``content`` of the statement files under ``path`` that are not blank."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.[oqOQ][fF][xX]", recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("file"), F.col("value").alias("content")).where(text.trimmed(F.col("content")) != "")


def gate(uploads: DataFrame) -> DataFrame:
    """``uploads`` (``file``, ``content``) with ``reason``: null for a statement, else why it is turned away (``extension``, ``empty``, ``no_transactions``)."""
    name, blank = F.lower("file"), text.trimmed(F.coalesce("content", F.lit(""))) == ""
    lines = F.lower("content").contains("<stmttrn>")
    reason = F.when(~F.coalesce(name.endswith(".ofx") | name.endswith(".qfx"), F.lit(False)), "extension").when(blank, "empty").when(~lines, "no_transactions")
    return uploads.withColumn("reason", reason)


def leading_number(value: Column) -> Column:
    """The number that a text begins with, as decimal; commas are thousands separators."""
    return F.regexp_extract(F.regexp_replace(value, ",", ""), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("decimal(15,2)")


def with_balance(files: DataFrame, now: Column) -> DataFrame:
    """``files`` with ``balance`` and ``balance_date`` from the blocks ``ledger`` and ``avail``: the ledger's balance if it is a number, else the available one.

    In steps, each a column that the next one reads: in one expression every
    part of the date would hold all that finds its text.
    """
    tag = lambda name, of: text.tag_value(F.col(of), name)
    f = files.withColumns({"__ledger": tag("BALAMT", "ledger"), "__avail": tag("BALAMT", "avail"), "__ledger_at": tag("DTASOF", "ledger"), "__avail_at": tag("DTASOF", "avail")})
    f = f.withColumns({c: leading_number(F.nullif(F.col(c), F.lit(""))) for c in ("__ledger", "__avail")})
    f = f.withColumn("__when", F.nullif(F.when(F.col("__ledger").isNotNull(), F.col("__ledger_at")).otherwise(F.col("__avail_at")), F.lit("")))
    return f.withColumns({"balance": F.coalesce("__ledger", "__avail"), "balance_date": dates.parse_ofx_date(F.col("__when"), now)})


#: A statement's head.
HEAD = ("BANKID", "ACCTID", "ACCTTYPE", "CURDEF")


def head_columns() -> tuple[Column, ...]:
    """``bank_id``, ``acct_id``, ``acct_type``, ``currency`` from columns with the names of the tags."""
    return (F.col("BANKID").alias("bank_id"), F.col("ACCTID").alias("acct_id"), text.first_filled(F.col("ACCTTYPE"), F.lit("CHECKING")).alias("acct_type"), text.first_filled(F.col("CURDEF"), F.lit("BRL")).alias("currency"))


def parse(files: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per file: bank, account, balance and an array of transactions.

    A transaction needs a date, an amount that is a number, and an id; others are in ``rejected``.
    """
    now = F.lit(None).cast("string") if now is None else now
    t = files.withColumn("content", text.same_line_ends(F.col("content")))
    t = t.withColumns({"ledger": F.try_element_at(text.tag_blocks(F.col("content"), "LEDGERBAL"), F.lit(1)), "avail": F.try_element_at(text.tag_blocks(F.col("content"), "AVAILBAL"), F.lit(1))})
    t = with_balance(t.withColumns({name: text.tag_value(F.col("content"), name) for name in HEAD}), now)

    def transaction(block: Column) -> Column:
        of = lambda name: text.tag_value(block, name)
        return F.struct(
            of("FITID").alias("fit_id"), text.first_filled(of("TRNTYPE"), F.lit("OTHER")).alias("type"), of("DTPOSTED").alias("posted"),
            leading_number(of("TRNAMT")).alias("amount"), text.first_filled(of("NAME"), of("MEMO"), F.lit("Sem descrição")).alias("name"), of("MEMO").alias("memo"),
        )

    every = F.transform(text.tag_blocks(F.col("content"), "STMTTRN"), transaction)
    whole = lambda r: (r.fit_id != "") & (r.posted != "") & r.amount.isNotNull()
    rows, others = F.filter(every, whole), F.filter(every, lambda r: ~whole(r))
    return t.select("file", *head_columns(), "balance", "balance_date", rows.alias("transactions"), others.alias("rejected"))


#: What stands before each statement line; reading by it cuts a large file into records that several tasks share.
MARK = "<STMTTRN>"


def read_records(spark: SparkSession, path: str, glob: str = "*.[oqOQ][fF][xX]") -> DataFrame:
    """``file``, ``block``, ``at``, ``value``: the pieces of statement files between the marks of their lines, in the order of (``block``, ``at``) in a file.

    Spark splits a file by bytes, and each task reads the pieces that begin in its part, so a file of any size is no row.
    """
    pieces = spark.read.text(path, lineSep=MARK, pathGlobFilter=glob, recursiveFileLookup=True)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), text.same_line_ends(F.col("value")).alias("value"))


def statements(records: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per file as ``parse`` gives it, without its transactions: from what stands before the first mark and after the last, and where the balances stand.

    Of a file's pieces, a task keeps three at most.
    """
    now = F.lit(None).cast("string") if now is None else now
    place = F.struct("block", "at")
    holds = lambda tag: F.min_by(F.when(F.lower("value").contains(f"<{tag}>"), F.col("value")), F.when(F.lower("value").contains(f"<{tag}>"), place))
    files = records.groupBy("file").agg(
        F.min_by("value", place).alias("head"), F.max_by("value", place).alias("tail"), holds("ledgerbal").alias("ledger"), holds("availbal").alias("avail"), F.max(F.lower("value").contains("</stmttrn>")).alias("closed"),
    )
    block = lambda c, name: F.try_element_at(text.tag_blocks(F.col(c), name), F.lit(1))
    files = files.withColumns({"ledger": block("ledger", "LEDGERBAL"), "avail": block("avail", "AVAILBAL")})
    files = files.withColumns({f"{name}_{c}": text.tag_value(F.col(c), name) for name in HEAD for c in ("head", "tail")})
    files = files.withColumns({name: text.first_filled(F.col(f"{name}_head"), F.col(f"{name}_tail")) for name in HEAD})
    return with_balance(files, now).select("file", *head_columns(), "balance", "balance_date", "closed")


def lines(records: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per statement line with its account, and ``missing``: the names of what it lacks; empty for a line that can be stored.

    For files whose marks are in capitals, as the format has them; ``parse`` takes any case, a file in one row.
    """
    now = F.lit(None).cast("string") if now is None else now
    about = statements(records).select("file", "acct_id", "closed")
    first = records.groupBy("file").agg(F.min(F.struct("block", "at")).alias("first"))
    joined = records.join(about.join(first, "file"), "file").where(F.struct("block", "at") > F.col("first"))
    # a line ends where it is closed; in a file that closes its lines, what is not closed is none
    end = F.instr(F.lower("value"), "</stmttrn>")
    joined = joined.where(~F.col("closed") | (end > 0)).withColumn("value", F.when(F.col("closed"), F.expr("substring(value, 1, instr(lower(value), '</stmttrn>') - 1)")).otherwise(F.col("value")))
    of = lambda name: text.tag_value(F.col("value"), name)
    # one row each, so that a filter on what is missing reads the values and not the text again
    values = F.struct(of("FITID").alias("fit_id"), of("DTPOSTED").alias("posted"), leading_number(of("TRNAMT")).alias("amount"), text.first_filled(of("NAME"), of("MEMO"), F.lit("Sem descrição")).alias("description"), text.first_filled(of("TRNTYPE"), F.lit("OTHER")).alias("type"))
    r = joined.select("file", "acct_id", F.inline(F.array(values)))
    lacking = F.array_compact(F.array(F.when(F.col("fit_id") == "", F.lit("fit_id")), F.when(F.col("posted") == "", F.lit("posted")), F.when(F.col("amount").isNull(), F.lit("amount"))))
    return r.select("file", "acct_id", text.external_id_ofx(F.col("acct_id"), F.col("fit_id")).alias("external_id"), "description", "amount", dates.parse_ofx_date(F.col("posted"), now).alias("date"), "type", lacking.alias("missing"))


def transactions(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per statement line, with its logical key; files without lines give none."""
    now = F.lit(None).cast("string") if now is None else now
    r = parsed.select("file", "acct_id", F.posexplode("transactions").alias("line", "t"))
    return r.select(
        "file", "line", "acct_id", text.external_id_ofx(F.col("acct_id"), F.col("t.fit_id")).alias("external_id"), F.col("t.name").alias("description"),
        F.col("t.amount").alias("amount"), dates.parse_ofx_date(F.col("t.posted"), now).alias("date"), F.col("t.type").alias("type"),
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """One row per statement line that cannot be stored: ``file``, its number among them, its texts and the names of what is missing."""
    r = parsed.select("file", F.posexplode("rejected").alias("line", "t"))
    lacking = [F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in (("fit_id", F.col("t.fit_id") == ""), ("posted", F.col("t.posted") == ""), ("amount", F.col("t.amount").isNull()))]
    return r.select("file", "line", "t.fit_id", "t.name", "t.posted", F.array_compact(F.array(*lacking)).alias("missing"))
