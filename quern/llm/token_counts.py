"""Token counts of whole texts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import take_over
from .vocabulary import counter, default_path

#: Rows that Python holds at once.
SLICE = 512


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One scan, no shuffle.

    path: the vocabulary's file, as tokenizers reads it; every executor must have it. Counts equal the library's,
    without added begin or end tokens; special strings inside a text count as one token each.
    Null and empty texts have 0 bytes and tokens; texts of any length are counted whole. Rows are independent: repeated rows give repeated results, an
    empty table an empty one. Other columns are not read, whatever their names.
    """
    path = path or default_path()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        of = counter(path)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                tokens = [of.count(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
