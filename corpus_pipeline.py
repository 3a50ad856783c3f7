"""From raw documents to token ids: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``;
the last returns token ids.  ``run`` writes each stage's rows as Parquet in the
session's shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalbook.llm import bpe, common, mixture, near_dups, repeats, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon calls toxic go."""
    scored = toxicity.score(docs, toxicity.fitted(spark, docs, sf_dir), into="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard 0.8.

    Rows that share a doc_id stay or go each by its own text.
    """
    gone = near_dups.classes(docs, words=5, parts=80, whole=100, bands=28).where(~F.col("kept")).select("doc_id", F.col("mark").alias("__mark")).distinct()
    return docs.withColumn("__mark", F.xxhash64("text")).join(gone, ["doc_id", "__mark"], "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go out of the texts; a character that is cut goes whole.

    A document of which nothing is left stays with an empty text; a null text stays null.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # the other columns travel as one, so that their names cannot clash with the operator's
    held = docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias("__null")).alias("__rest"))
    left = repeats.without_repeats(held, carry=("__rest",), characters=True)
    text = F.when(~F.col("__rest")["__null"], F.col("kept"))
    left = left.select("doc_id", text.alias("text"), *(F.col("__rest")[c].alias(c) for c in rest)).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken by weight, some documents several times, some not at all."""
    return mixture.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and proof that they decode to the text."""
    return bpe.round_trip(docs, keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixture", mix),
    ("bpe", tokens),
]
#: Hashing, similarity joins and BPE have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name)
            common.delete(before)  # what a stage has read is not needed any more; the input stays
    return docs
