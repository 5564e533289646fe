"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: Vectors that the rotation and the radius are learnt from, those of the smallest hashes; and their queries.
SAMPLE, TRIALS = 4096, 256
#: Share of the true neighbours that the radius must reach within the sample.
REACH = 0.94
#: Bytes of a shard's vectors, and queries of a block.
HELD, BLOCK = 8 * 2**20, 16_384
#: Bits of a substring: as many as tell a shard's rows apart, between these.
NARROW, WIDE = 8, 16
ROUNDS = 30
#: Different lengths of vectors that a table may have.
LENGTHS = 16
OUT = "query_id long, vec_id long, score double"


class Codes:
    """Binary codes: centred, turned to principal axes, then rotated so that signs lose least (iterative quantisation)."""

    def __init__(self, sample: np.ndarray, bits: int = 64):
        self.bits = min(bits, sample.shape[1])
        self.mean = sample.mean(axis=0)
        flat = sample - self.mean
        _, axes = np.linalg.eigh(flat.T @ flat / len(sample))
        axes = axes[:, ::-1][:, : self.bits]
        flat = (sample - self.mean) @ axes
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.turn = axes @ turn

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.turn > 0

    def parts(self, rows: int) -> list[np.ndarray]:
        """The bits of each substring of an index of so many rows."""
        width = min(max(int(rows - 1).bit_length(), NARROW), WIDE)
        return np.array_split(np.arange(self.bits), -(-self.bits // width))

    def radius(self, sample: np.ndarray, k: int, rows: int) -> int:
        """The least radius within which the sample's queries find the share REACH of their nearest.

        The k nearest among rows are as near as the nearest k * sample / rows of the sample, so the radius falls as
        the table grows.
        """
        k = max(1, -(-k * len(sample) // rows))
        if len(sample) <= k + 1:
            return self.bits
        signs, queries = self.signs(sample), np.arange(min(TRIALS, len(sample)))
        scores = sample[queries] @ sample.T
        scores[queries, queries] = -np.inf
        near = np.argpartition(-scores, k, axis=1)[:, :k]
        apart = np.sort((signs[near] != signs[queries][:, None, :]).sum(axis=2), axis=None)
        return int(apart[min(len(apart) - 1, int(np.ceil(REACH * len(apart))))])


class Index:
    """A shard of the index: for each substring, the postings of each value. tally counts rows met, probed and within."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors = codes, ids, vectors
        self.parts = codes.parts(len(ids))
        signs = codes.signs(vectors)
        self.packed = np.packbits(signs, axis=1)
        self.postings = []
        for part in self.parts:
            value = self.value(signs, part)
            self.postings.append((np.argsort(value, kind="stable"), np.searchsorted(np.sort(value), np.arange(2 ** len(part) + 1))))
        #: For each width of a substring, all differences of two values, those of fewest bits first, and where each number of bits ends.
        self.masks = {}
        for width in {len(p) for p in self.parts}:
            bits = np.bitwise_count(np.arange(2**width))
            self.masks[width] = np.argsort(bits, kind="stable"), np.cumsum(np.bincount(bits))
        self.tally = np.zeros(3, np.int64)

    @staticmethod
    def value(signs: np.ndarray, part: np.ndarray) -> np.ndarray:
        return signs[:, part] @ (1 << np.arange(len(part)))

    def probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """The rows whose substring j differs from value in at most radius bits: the postings of each such value."""
        order, starts = self.postings[j]
        masks, ends = self.masks[len(self.parts[j])]
        values = value ^ masks[: ends[min(radius, len(ends) - 1)]]
        first, sizes = starts[values], starts[values + 1] - starts[values]
        first, sizes = first[sizes > 0], sizes[sizes > 0]
        return order[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def within(self, values: list[int], code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from the query's in at most radius bits.

        Substring j is probed up to r_j with the sum of r_j + 1 equal to radius + 1: were every substring farther away
        than that, the codes would differ in more than radius bits.
        """
        each, more = divmod(min(radius, self.codes.bits) + 1, len(values))
        found = np.zeros(len(self.ids), bool)
        for j, v in enumerate(values):
            if (r := each - 1 + (j < more)) >= 0:
                found[self.probe(j, v, r)] = True
        probed = np.flatnonzero(found)
        rows = probed[np.bitwise_count(self.packed[probed] ^ code).sum(axis=1) <= radius]
        self.tally += (len(self.ids), len(probed), len(rows))
        return rows

    def scores(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows that may be among the k nearest, and their scores.

        A product of matrices adds up in an order that depends on a row's place, so what it leaves is scored again row
        by row: equal vectors have equal scores, wherever they are.
        """
        if len(rows) > k:
            rough = self.vectors[rows] @ query
            room = 1e-12 * (1 + np.abs(self.vectors[rows]).max() * np.abs(query).sum())
            rows = rows[rough >= np.partition(rough, -k)[-k] - room]
        return rows, np.multiply(self.vectors[rows], query).sum(axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, radius: int, k: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The k nearest within the radius, which is widened until it holds least rows."""
        signs = self.codes.signs(queries)
        codes = np.packbits(signs, axis=1)
        values = np.stack([self.value(signs, p) for p in self.parts], axis=1).tolist()
        for q, query, code, value in zip(query_ids, queries, codes, values, strict=True):
            r = radius
            while True:
                rows = self.within(value, code, r)
                rows = rows[self.ids[rows] != q]
                if len(rows) >= least or r >= self.codes.bits:
                    break
                r += 4
            rows, scores = self.scores(rows, query, k)
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield q, self.ids[rows][best], scores[best]


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row whose id every divides, by inner product.

    Codes are learnt from at most SAMPLE vectors, and so is the Hamming radius that reaches REACH of the neighbours.
    Every row is indexed: rows are dealt to shards of HELD bytes, and each block of queries meets each shard once. Inside,
    substrings of the codes are indexed, probing by the pigeonhole principle finds every code within the radius, and their
    original vectors are ranked in double precision. A shard in which a query finds too few for k in all widens the
    radius, up to all its rows.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors of different lengths have no inner product: each length is searched by itself, and more than LENGTHS lengths
    are an error. Ties go to the smaller id. Rows with the query's id are its own; repeated ids among the rest are
    ranked one by one. Other columns are not read, whatever their names. An empty table gives none.
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(column).cast("array<double>").alias("_v")).filter("_id IS NOT NULL AND size(_v) > 0").filter(sound)
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("_v").alias("n")).count().limit(LENGTHS + 1).collect()}
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [alike(rows.filter(F.size("_v") == n), sizes[n], n, k, every) for n in sorted(sizes)]
    for one in found:
        out = one if len(found) == 1 else out.unionByName(one)
    return out


def alike(rows: DataFrame, n: int, length: int, k: int, every: int) -> DataFrame:
    """search() over n rows _id, _v of one length."""
    spark = rows.sparkSession
    sample = np.array([r["_v"] for r in rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()], float)
    codes = Codes(sample)
    radius = codes.radius(sample, k, n)
    shards = -(-n * length * 8 // HELD)
    queries = cut(rows.filter(F.col("_id") % every == 0))
    asked = queries.count()
    blocks = max(1, -(-asked // BLOCK), min(-(-asked // 512), -(-spread(spark) // shards)))
    least = -(-k // shards)
    index = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards).cast("long"))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = queries.withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        shard = Index(codes, rows["_id"].to_numpy(), np.stack(rows["_v"].to_list()).astype(float))
        found = list(shard.search(queries["_id"].to_numpy(), np.stack(queries["_v"].to_list()).astype(float), radius, k, least))
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    near = index.groupBy("_shard", "_block").cogroup(queries.groupBy("_shard", "_block")).applyInPandas(meet, OUT)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
