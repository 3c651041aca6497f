"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch holds the present count of documents (``tokens``; null: the document is deleted). A commit compares it with what the
book holds of those documents and appends signed rows: a new document adds, a deleted one takes away, a revised one does both
(also where its source or language changed). Totals are sums of deltas and never need the texts again.

Batches are numbered by name. A batch is written to a folder of its own and then named in ``done``; a name already there is
skipped, and what a lost attempt left is overwritten, so a commit may be repeated at any time. ``compact`` folds all
batches into one.

Null source or language is the empty text; null texts have no tokens. Rows of a batch that repeat an identifier count each on their
own, and so do rows without one. A later batch replaces all rows of each identifier that it names; null is an identifier here like
any other. Unknown documents to delete change nothing.

``words-1`` and ``bytes4-1`` are what SQL can express: words between blanks, and a quarter of the bytes as an estimate. ``encoded``
counts the tokens of the byte-level encoder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byte_bpe
from touchline.session import new_folder

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
COUNTERS: dict[str, Column | None] = {"words-1": None, "bytes4-1": None}
DELTAS = "doc_id bigint, source string, lang string, tokenizer string, sign bigint, tokens bigint"


def counter(version: str) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    if version == "words-1":  # runs of what is not white space
        return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    if version == "bytes4-1":
        return F.ceil(F.octet_length(text) / 4).cast("bigint")
    raise ValueError(f"no tokenizer version {version}")


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def counted(docs: DataFrame, version: str) -> DataFrame:
    """A batch of the present counts of ``docs``."""
    return docs.select("doc_id", blank("source"), blank("lang"), F.lit(version).alias("tokenizer"), counter(version).alias("tokens"))


def encoded(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """A batch of the present counts of ``docs`` in tokens of the byte-level encoder with this vocabulary."""
    coded = byte_bpe.encode(docs, vocabulary, "doc_id", "source", "lang")
    tokens = (F.octet_length("ids") / 4).cast("bigint")
    return coded.select("doc_id", blank("source"), blank("lang"), F.lit(version).alias("tokenizer"), tokens.alias("tokens"))


def removed(docs: DataFrame, version: str) -> DataFrame:
    """A batch that deletes ``docs``."""
    return counted(docs.withColumn("text", F.lit("")), version).withColumn("tokens", F.lit(None).cast("bigint"))


def new_book(spark: SparkSession) -> str:
    return new_folder(spark, "token-book")


class Book:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _names(self) -> list[str]:
        """Committed batches in order, from the markers; a few rows, one for each batch."""
        if not self._exists("done"):
            return []
        rows = self.spark.read.schema("at bigint, batch string").json(f"{self.path}/done/*").collect()
        return [r["batch"] for r in sorted(rows)]

    def _exists(self, *parts: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        place = hadoop.Path("/".join([self.path, *parts]))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def deltas(self) -> DataFrame:
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*[f"{self.path}/deltas/{n}" for n in names])

    def commit(self, name: str, batch: DataFrame) -> bool:
        """Append the batch unless it is there; True if it was appended."""
        names = self._names()
        if name in names:
            return False
        # Rows in ``documents`` of a batch stand for that many documents (those of ``compact``).
        each = F.col("documents") if "documents" in batch.columns else F.lit(1)
        present = batch.groupBy(*KEY, "source", "lang").agg(F.sum(F.when(F.col("tokens").isNotNull(), each).otherwise(0)).alias("sign"), F.sum("tokens").alias("tokens"))
        signed = present.where("sign > 0").select(*KEY, "source", "lang", "sign", "tokens")
        if names:
            named = present.select(F.col("doc_id").alias("named"), F.col("tokenizer").alias("version")).distinct()
            same = F.col("doc_id").eqNullSafe(F.col("named")) & (F.col("tokenizer") == F.col("version"))
            held = self.deltas().groupBy(*KEY, "source", "lang").agg(F.sum("sign").alias("sign"), F.sum("tokens").alias("tokens")).where("sign <> 0 or tokens <> 0")
            back = held.join(named, same, "left_semi")
            signed = signed.unionByName(back.select(*KEY, "source", "lang", (-F.col("sign")).alias("sign"), (-F.col("tokens")).alias("tokens")))
        # A document that did not change leaves no rows.
        net = signed.groupBy(*KEY, "source", "lang").agg(F.sum("sign").alias("sign"), F.sum("tokens").alias("tokens")).where("sign <> 0 or tokens <> 0")
        net.select("doc_id", "source", "lang", "tokenizer", "sign", "tokens").write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self.spark.range(1).select(F.lit(len(names)).cast("bigint").alias("at"), F.lit(name).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{self.path}/done/{len(names):08d}")
        return True

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``documents``, ``tokens`` of what is left; groups without documents are gone."""
        sums = self.deltas().groupBy(*GROUP).agg(F.sum("sign").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self, path: str) -> Book:
        """The book with one row for each document, source and language, as a new book under ``path``."""
        out = Book(self.spark, path)
        left = self.deltas().groupBy(*KEY, "source", "lang").agg(F.sum("sign").alias("sign"), F.sum("tokens").alias("tokens")).where("sign > 0")
        out.commit("compacted", left.select(*KEY, "source", "lang", "tokens", F.col("sign").alias("documents")))
        return out
