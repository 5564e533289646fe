"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, take_over

SLICE = 512
#: Rows of features that the driver fetches at once.
FETCHED = 1000
#: Features are hashed to 2 ** BITS weights.
BITS = 18
#: The parameter sample: at most so many labelled documents are learnt from, those of the smallest hashes; and so many times over.
SAMPLE, EPOCHS = 8000, 3
#: FTRL-proximal's step sizes and regularisation.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.005, 0.01
THRESHOLD = 0.3
REPEATED = np.uint32(0x5EED)
#: A word is a run of letters, of digits, or of other signs.
PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def hashed_parts(word: bytes) -> bytes:
    parts = PART.findall(word.decode("utf-8", "replace"))
    return b"".join(zlib.crc32((p if not p.isdigit() else "0").encode()).to_bytes(4, "little") for p in parts)


@functools.cache
def memo() -> Memo:
    return Memo("quality", hashed_parts)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed word unigrams and bigrams of a text and their values, log(1 + count) scaled to the length 1.

    A word that follows itself is one bigram for all words.
    """
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    one = np.frombuffer(b"".join(map(memo().__getitem__, words)), "<u4")
    if not len(one):
        return np.empty(0, np.int64), np.empty(0)
    again = one[:-1] == one[1:]
    two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] * np.uint32(0x85EBCA6B) + np.uint32(1))
    two[again] = REPEATED
    keys = np.concatenate([one * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F)]) >> np.uint32(32 - BITS)
    at, counts = np.unique(keys, return_counts=True)
    values = np.log1p(counts)
    return at.astype(np.int64), values / math.sqrt(float(values @ values))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in their order: weights and bias."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(at):
        w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for at, values, label in rows:
            at, values = np.append(at, 2**BITS), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values))))) - label) * values
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(2**BITS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from labelled documents outside of the held-out fold.

    At most sample documents are taken, by a hash of their ids, and turned to features on the executors, all at once into
    the checkpoint folder; the driver gets these FETCHED rows at a time and keeps them packed. Of a document with several labels the smallest counts; labels other than 0 and 1 and those without a document
    do not. Without any, all weights are 0.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], names=schema.names)

    rows = found.select(F.col("doc_id").cast("string").alias("id"), "text", "_label").mapInArrow(make, schema)
    rows = cut(rows).coalesce(max(1, math.ceil(sample / FETCHED))).toLocalIterator()
    packed = sorted((zlib.crc32(f"order {r.id}".encode()), r.id, bytes(r["at"]), bytes(r["values"]), r["label"]) for r in rows)
    return train([(np.frombuffer(at, "<i4"), np.frombuffer(values, "<f4"), label) for _, _, at, values, label in packed])


def scored(batch: pa.RecordBatch, text: int, weights: np.ndarray, bias: float) -> np.ndarray:
    sums = [float(weights[at] @ values) for at, values in map(features, batch.column(text).to_pylist())]
    return 1 / (1 + np.exp(-np.clip(np.array(sums, float) + bias, -35, 35)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1), predicted (score >= threshold). One scan, no shuffle of the texts.

    sample: learns from at most so many labelled documents. The score comes from the text alone; null and empty texts
    score the bias, texts of any length are scored whole. Repeated rows score alike; a null doc_id is not held out.
    Other columns are not read, whatever their names. An empty table gives none.
    """
    weights, bias = fit(docs, labels, sample)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored(batch, 1, weights, bias))], names=schema.names)

    out = docs.select("doc_id", "text").mapInArrow(score, schema)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs' rows and columns, without those that the classifier rejects. Nulls, empty and long texts, repeated rows: as classify()."""
    weights, bias = fit(docs, labels, sample)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                yield batch.filter(pa.array(scored(batch, text, weights, bias) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
