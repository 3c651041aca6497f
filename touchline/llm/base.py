"""Reading tables, running Python over whole Arrow batches, and folders shared by all executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from touchline.session import cut_lineage

__all__ = ["chunks", "cut_lineage", "fold_of", "over_texts", "raw", "table"]

# Bytes of text that a helper works on at once; one longer text is worked on whole.
CHUNK_BYTES = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` as ``_0``, ``_1`` and so on, then the text as bytes; other columns, whatever their names, stay behind."""
    return docs.select(*[docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(keep)], docs["text"].cast("binary").alias("_text"))


def fold_of(key: Column, folds: int = 5) -> Column:
    """``crc32`` of the key as text modulo ``folds``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def over_texts(docs: DataFrame, work: Callable[[list[bytes]], dict[str, list]], schema: str, *keep: str) -> DataFrame:
    """Add the columns that ``work`` makes of a list of texts (null: empty) to the columns ``keep``.

    ``work`` gets texts of one Arrow batch, about ``CHUNK_BYTES`` at a time, and returns a list per new column.
    """
    source = raw(docs, *keep)
    new = StructType.fromDDL(schema).fields
    types = [to_arrow_type(f.dataType) for f in new]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in chunks(texts):
                made = work(texts[a:b])
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns = [pa.array(v, t) for v, t in zip(made.values(), types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + columns, names=names)

    made_fields = [f"`_m{i}` {f.dataType.simpleString()}" for i, f in enumerate(new)]
    names = [f"_{i}" for i in range(len(keep))] + [f"_m{i}" for i in range(len(new))]
    return source.mapInArrow(run, ", ".join([*fields, *made_fields])).toDF(*keep, *[f.name for f in new])
