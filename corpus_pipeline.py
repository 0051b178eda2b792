"""The corpus pipeline over ``documents``: stages written as Parquet and read again as the next one's documents.

Every stage works on all that the one before kept. A stage that filters returns its documents' own columns
unchanged, whatever others there are; the last one returns packed pieces.

Defined results: null texts and texts without a letter go with the language stage. Of a group of linked
documents the row of smallest doc_id stays, rows without doc_id only where the group has no other, and of
rows with equal doc_id the one that comes first in the table. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, langid, ngram_join, packing, quality
from corpusloom.llm.common import free_name, numbered, own_columns, table, written

#: Log odds, added up over a text's windows, from which it is noise: 99 to 1. A short text needs a score beyond
#: 0.99 (of 51282 documents looked at, none had more than 0.94), a long one no more than the larger half.
LEAST_EVIDENCE = 4.6
#: Rows to drop that are broadcast at most; more are dropped by a shuffled join.
FEW_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those that look like scrambled letters rather than any learned language."""
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    judged = langid.predict(docs, langid.trained_on(docs, noise=True), names=(lang, score))
    odds = F.log(F.col(score)) - F.log(F.greatest(1 - F.col(score), F.lit(1e-9)))
    windows = F.greatest(F.lit(1.0), F.octet_length(langid.letters(F.col("text"))) / langid.WINDOW)
    noise = F.when(F.col(lang) == langid.NOISE, odds * windows > LEAST_EVIDENCE).otherwise(False)
    return judged.where((F.col(lang) != langid.UNKNOWN) & ~noise).select(*own_columns(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what any rule of the cascade rejects."""
    failed = free_name(docs, "_failed")
    return quality.judge(docs, failed).where(F.col(failed).isNull()).select(*own_columns(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents. Rows are told apart by numbers that each scan repeats."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = ngram_join.jaccard_groups(rows.select(key.alias("_key"), F.col(row).alias("_at"), "text"), "_key", "_at")
    gone = groups.where(F.col("_key.row") != F.col("component_id.row")).select(F.col("_key.row").alias(row))
    gone = written(gone, "pipeline-copies")
    few = gone.count() <= FEW_ROWS
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*own_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents that are left."""
    return packing.pack_documents(docs, bpe.vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: The first and the last stage can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
