"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_checked, prefix_sums, spread

#: Words of a packet: a longer document stands in its queue as several, so that no source is ahead by more.
PACKET = 128
#: Virtual time is cut to so many ranges a unit, and each range again, up to LATEST.
RANGES, LATEST = 1024, 8.0
BROADCAST = 200_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """_source, _rank, source_size, target of each source. sizes: one row for each source, with source and source_size.

    Sources weigh by their place in code point order, null last. A source's target stops at most times its size; what
    is above goes to the others by weight. In order of cap by weight, the sources before the first one whose cap is no
    less than its share of the rest are those that stop; that share is what resharing again and again comes to.
    """
    named = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    named = named.withColumn("_cap", F.col("source_size") * most)
    by_room = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_rank").asc())
    everything = Window.partitionBy(F.lit(1))
    named = named.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = named.withColumn("_level", F.col("_left") / F.sum("_weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(everything)["_level"]
    return named.select("_source", "_rank", "source_size", F.least(F.col("_cap").cast("double"), level * F.col("_weight")).alias("target"))


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs' columns carry, and _source, size, _order (the place in the shuffled queue: md5 of doc_id) and _range, the part of the queue that it is in."""
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"_c_{c}") for c in carry),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_source"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("_order"),
        words("text").alias("size"),
    )
    return rows.withColumn("_range", F.floor(F.coalesce(F.conv(F.substring("_order", 1, 4), 16, 10).cast("long"), F.lit(0)) * spread(docs.sparkSession) / 65536))


def queued(rows: DataFrame, narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """rows of keyed() with _rank, source_size, target of their source, and _before: the words ahead of them in its queue.

    narrow: rows without what they carry, written once. Sources are split by ranges of the queue, so no task holds one.
    """
    ahead = prefix_sums(rows, "_source", "_range", ["_order", "size"], F.col("size"), "_before", narrow)
    return join_checked(ahead, sources, "_source", "inner", BROADCAST)


def opened(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, int]:
    """What the queues are: narrow rows of keyed() with doc_id, the sources with their targets, and the budget. Texts are read once."""
    narrow = cut(keyed(docs, ["doc_id"]))
    sizes = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("_source") != "-", F.expr("substring(_source, 2)")))
    sources = cut(targets(sizes, weights, most))
    return narrow, sources, sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]


def truncated(packets: DataFrame, budget: int) -> tuple[float, int, int, int]:
    """Where the queue of all packets (_at: _finish, _rank, _start; _words) ends: the first _at that the budget doesn't hold whole, and the words left for it.

    Packets are range-sorted by finish time: totals of ranges find the one in which the budget ends, and the packets of
    this one alone are put in order, again by parts, so that no task holds more than a part of a range.
    """
    time = F.least(F.col("_at._finish"), F.lit(LATEST)) * RANGES
    ranged = packets.withColumns({"_one": F.lit(0), "_range": F.floor(time).cast("long"), "_part": F.floor((time - F.floor(time)) * RANGES).cast("long")})
    totals = ranged.groupBy("_range").agg(F.sum("_words").alias("_words")).withColumn("_sum", F.sum("_words").over(Window.orderBy("_range")))
    last = totals.filter(F.col("_sum") > budget).orderBy("_range").select("_range", "_sum", "_words").first()
    if last is None:
        return float("inf"), 0, 0, 0
    inside = prefix_sums(ranged.filter(F.col("_range") == last["_range"]), "_one", "_part", ["_at"], F.col("_words"), "_ahead")
    left = budget - (last["_sum"] - last["_words"])
    found = inside.filter(F.col("_ahead") + F.col("_words") > left).agg(F.min(F.struct("_at", "_ahead")).alias("first")).first()["first"]
    return *found["_at"], left - found["_ahead"]


def at(finish: Column, start: Column) -> Column:
    return F.struct(finish.cast("double").alias("_finish"), F.col("_rank").cast("long").alias("_rank"), start.cast("long").alias("_start"))


def end_at(end: tuple) -> Column:
    finish, rank, start, _ = end
    return F.struct(F.lit(finish).cast("double").alias("_finish"), F.lit(rank).cast("long").alias("_rank"), F.lit(start).cast("long").alias("_start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, packet: int = PACKET) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target (of its source), taken (its words in the mix, repeats counted).

    Each source is a queue that its shuffled documents join, again from its start when it ends, up to most times, in
    packets of at most packet words. A packet's virtual finish time is the words of the queue up to and with it over the
    source's target. All packets are range-sorted by finish time, over all sources, and truncated at the total budget, the
    words of all documents; ties go by source, and the last packet is cut to the word. A document's taken words are those
    of its packets before the cut. Sources end within a packet of each other's virtual time, so each comes within a few
    packets of its target. The order comes from doc_id alone, so reruns agree.

    Null and empty texts have size 0 and give nothing; a null source is the last one. Texts of any length are taken whole.
    Repeated rows and rows with the same doc_id are queued one after the other. Other columns are not read, whatever their
    names. An empty table gives none. Sources take one row each, which one task ranks.
    """
    narrow, sources, budget = opened(docs, weights, most)
    rows = cut(queued(narrow, narrow, sources))

    def of(turn: int) -> Column:
        begin = F.col("_before") + turn * F.col("source_size")

        def one(k: Column) -> Column:
            size = F.least(F.lit(packet).cast("long"), F.col("size") - k * packet)
            return F.struct(at((begin + k * packet + size) / F.col("target"), begin + k * packet).alias("_at"), size.alias("_words"))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet).cast("long")), one)

    several = F.when(F.col("size") > 0, F.concat(*(of(t) for t in range(most)))).otherwise(F.array())
    end = truncated(rows.select(F.inline(several)), budget)
    mine = lambda p: F.when(p["_at"] < end_at(end), p["_words"]).when(p["_at"] == end_at(end), F.lit(end[3]).cast("long")).otherwise(F.lit(0).cast("long"))
    taken = F.aggregate(several, F.lit(0).cast("long"), lambda s, p: s + mine(p))
    return rows.select(F.col("_c_doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: docs' rows and columns, as often as they are taken, sorted by virtual finish time over all partitions.

    As mix(), but documents are the packets and stay whole: the one that the budget ends in is in if it holds half of its
    words. Documents without words cost nothing and stay, once. Two reads: words alone give the queues and the cut, and
    only what is taken is sorted with its texts.
    """
    narrow, sources, budget = opened(docs, weights, most)

    def turns(rows: DataFrame) -> DataFrame:
        rows = queued(rows, narrow, sources).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        start = F.col("_before") + F.col("_turn") * F.col("source_size")
        return rows.withColumn("_at", at(F.coalesce(F.try_divide(start + F.col("size"), F.col("target")), F.lit(0.0)), start))

    end = truncated(turns(narrow).filter("size > 0").select("_at", F.col("size").alias("_words")), budget)
    inside = (F.col("_at") < end_at(end)) | ((F.col("_at") == end_at(end)) & (2 * F.lit(end[3]) >= F.col("size")))
    rows = turns(keyed(docs, docs.columns)).filter(F.when(F.col("size") > 0, inside).otherwise(F.col("_turn") == 0))
    return rows.orderBy("_at", "_order").select(*(F.col(f"`_c_{c}`").alias(c) for c in docs.columns))


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS o,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, row(cap / weight, r)) AS level FROM l WHERE cap >= level * weight),
t AS (SELECT l.source, l.r, l.source_size, least(CAST(l.cap AS DOUBLE), v.level * l.weight) AS target FROM l, v),
q AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, t.r, t.source_size, t.target,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT q.*, turn, p.range AS p
  FROM q, (SELECT unnest([0, 1, 2]) AS turn), LATERAL (SELECT unnest(range(0, (size + 127) // 128)) AS range) p),
p AS (
  SELECT id, r, target, least(128, size - p * 128) AS words, ahead + turn * source_size + p * 128 AS start FROM k),
o AS (
  SELECT id, words, CAST(sum(words) OVER (ORDER BY CAST(start + words AS DOUBLE) / target, r, start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM p),
b AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS budget FROM d),
g AS (SELECT id, sum(greatest(0, least(words, budget - (upto - words)))) AS taken FROM o, b GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g USING (id)
"""
