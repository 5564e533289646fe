"""The corpus pipeline: from documents to packed sequences, each stage written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, line_dedup, mixing, near_dup, packing, quality_classifier


def entry_point(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Stages are also called one by one, without run(): each sees to it that few whole texts go to Python at once."""

    @functools.wraps(stage)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(common.tuned(spark), docs, sf_dir)

    return called


@entry_point
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null and empty texts score the bias; repeated rows stay or go together."""
    return quality_classifier.accepted(docs, common.table(spark, sf_dir, "labels"))


@entry_point
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that recur across documents; a document stays even if no line of it does, and so do null and empty texts and repeated rows."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


@entry_point
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike at 0.8 or more; null, empty and blank texts stay, repeated rows are one."""
    return near_dup.deduplicated(docs, n=5, percent=80)


@entry_point
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of their virtual finish times; a document comes as often as it is taken, one without words once."""
    return mixing.schedule(docs)


@entry_point
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is one end token."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("source mixing", mix), ("best-fit packing", pack)]

#: Neither the classifier nor the template tree can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again.

    A stage's folder is removed when the next one has been written, the last one when the packing has encoded it, which
    it checkpoints. Extra columns of documents are carried through, whatever their names; an empty table gives no rows.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return packed


def remove(spark: SparkSession, path: str | None) -> None:
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
