"""A corpus pipeline of five stages: each takes documents and returns documents, the last one their tokens.

Every stage works on what its predecessor kept. The first four return the columns of ``documents``. Null texts pass through the
filters as empty texts; an empty table gives empty tables with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byte_bpe, decontam, ngram_join, pii, toxicity
from touchline.llm.base import cut_lineage, table
from touchline.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not reject. Learned from the documents and labels of the folder, applied to ``docs``."""
    model = toxicity.learn(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, *docs.columns).toDF(*docs.columns, "_score", "_predicted", "_hits")
    return scored.where("_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least identifier (null last), any one of equal identifiers.

    Rows are told apart by a number, written once, so copies that share an identifier or have none are found as well, and another
    text under the identifier of a copy stays. Empty documents have no duplicates.
    """
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    members = found.join(rows.select("_row", "doc_id"), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"))
    gone = found.join(first.select(F.col("least._row").alias("_row")), "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark."""
    found = decontam.overlaps(docs, table(spark, folder, "benchmark"), *docs.columns).toDF(*docs.columns, "_words", "_overlaps")
    return found.where(F.size("_overlaps") == 0).select(*docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents; personal data is replaced by its kind in angle brackets, and ``n_chars`` follows the new text."""
    masked = pii.mask(docs, *docs.columns).toDF(*docs.columns, "_masked")
    new = F.when(F.col("text").isNotNull(), F.col("_masked"))
    return masked.withColumns({"text": new, "n_chars": F.length(new).cast("bigint")}).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Number of tokens and digests of each document that is left."""
    return byte_bpe.digests(docs, public_tokenizers.path(VOCABULARY), "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_private),
    ("byte_bpe", tokenize),
]

# Learned scores and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
