"""The corpus pipeline: quality rules, toxicity, near-duplicate lines, near-duplicate documents, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchway.llm import jaccard, line_dedup, packing, quality, toxicity
from larchway.llm.common import Scratch, read
from larchway.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail a rule of the policy; a null text has no words and fails."""
    judged = quality.apply_policy(quality.ledger(docs, "doc_id", keep=("text", "lang", "source", "n_chars")), "v1")
    return judged.where("kept").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the threshold, by a model of the labels of what is left."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "doc_id", keep=("text", "lang", "source", "n_chars")).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that an earlier line makes redundant, equal ones of any length but blank ones; a document with no word left goes. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, least_equal=1)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where((F.col("_n_removed") == 0) | left).select("doc_id", "text", "lang", "source", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")).alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one with the smallest id, a null id last; of equal ids, the first.

    Ids may repeat or be null, so rows are numbered and grouped by their numbers, which are written to stay as they are.
    """
    rows = Scratch(spark, "numbered").table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    groups = jaccard.jaccard_components(rows, key="_row", size=SHINGLE, percent=PERCENT)
    members = groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard", dedup_documents), ("packing", pack)]

#: SQL has no tokenizer and no trained classifier; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
