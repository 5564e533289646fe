"""Best-fit packing planned on the histogram of lengths; documents take planned slots by joining on their rank within a length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, prefix_sums, spread, take_over
from .vocabulary import default_path, encoder

SLICE = 512
RUN = "length long, rank_from long, rank_to long, bin long, per_bin long, at long"


def pieces(docs: DataFrame, limit: int, path: str, end: int = 0, text: str = "text") -> DataFrame:
    """Each document's token ids and then the id end, cut into pieces of limit tokens only if longer: doc_id, piece, start, length, ids_crc32."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        of, last, step = encoder(path), int(end).to_bytes(4, "little"), limit * 4
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(of.encode(batch.column(1).to_pylist())):
                    ids += last
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        row.append(k), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)
            give_back()

    return docs.select("doc_id", text).mapInArrow(encode, schema)


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, bin, per_bin, at).

    The piece of that length and rank r (rank_from <= r < rank_to) goes to sequence bin + (r - rank_from) // per_bin,
    at offset at + (r - rank_from) % per_bin * length. Equal bins are kept as one range of numbers, so the work and
    the plan depend on the number of different lengths, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of bins (first, number)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            first, number = room[free].pop() if free is not None else (bins, -(-left // (limit // length)))
            if free is None:
                free, bins = limit, bins + number
            elif not room[free]:
                del room[free]
            each = free // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, limit - free))
                rank, left = rank + full * each, left - full * each
                if free % length:
                    room.setdefault(free % length, []).append((first, full))
            if full < number and left:  # fewer than a whole bin takes
                runs.append((length, rank, rank + left, first + full, each, limit - free))
                if free > left * length:
                    room.setdefault(free - left * length, []).append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < number:
                room.setdefault(free, []).append((first + full, number - full))
    return runs


def pack(docs: DataFrame, limit: int = 2048, path: str | None = None, end: int = 0, text: str = "text") -> DataFrame:
    """Packs whole documents into sequences of at most limit tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are encoded once and written to the checkpoint folder. Their histogram (at most limit rows) goes to the
    driver, where best-fit decreasing plans sequences; the plan comes back as runs of slots and pieces join it by
    their rank within their length. Ranks are prefix sums over (length, hash of doc_id), so a length that many
    pieces share is dealt over many tasks. The plan has a few runs per length, whatever the number of pieces.

    A null text counts as empty: it is one piece, the end token. Repeated rows are packed as often as they come.
    Pieces of equal length take slots by doc_id and piece; ties are interchangeable. Texts of any length are encoded
    whole, and a null doc_id is one like others. Other columns are not read, whatever their names. An empty table gives none.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, limit, path or default_path(), end, text))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, limit), RUN)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread(spark))))
    ranked = prefix_sums(salted, "length", "_salt", ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank")
    slots = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))).drop(runs["length"])
    nth = F.col("_rank") - F.col("rank_from")
    return slots.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"), (F.col("at") + nth % F.col("per_bin") * F.col("length")).alias("offset"))
