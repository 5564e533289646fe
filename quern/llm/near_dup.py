"""MinHash near-duplicates: documents are posted under their signature's coordinate-value pairs, and collisions are counted by prefix and skip merging."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, join_checked, small, take_over

SLICE = 512
#: Coordinates of a signature, and how many of them two documents must share to be compared. lost() says how likely a link
#: has fewer: at the similarity 0.8, twice in a hundred million.
COORDINATES, MATCHES = 64, 32
#: Members of a list that are held at once, and rows that are broadcast.
BLOCK, BROADCAST = 1024, 200_000
#: Members that meet one copy of a star, and links that are merged at once.
DEALT, HELD = 256, 200_000
#: Columns of shingles that are multiplied at once, and pairs up to which each is intersected on its own.
COLUMNS, SINGLY = 2048, 2000
FOLD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_hashes() -> Memo:
    return Memo("shingles", xxhash.xxh3_64_intdigest)


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return tuple(rng.integers(0, 2**63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles; with fewer words, of the whole sequence."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.empty(0, np.uint64)
    of = np.fromiter(map(word_hashes().__getitem__, split), np.uint64, len(split))
    with np.errstate(over="ignore"):
        if len(of) < n:
            h = np.array([len(of)], np.uint64)
            for k in range(len(of)):
                h = h * FOLD + of[k : k + 1]
        else:
            h = of[: len(of) - n + 1].copy()
            for k in range(1, n):
                h = h * FOLD + of[k : len(of) - n + 1 + k]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    mask, odd = permutations()
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 4096):
            least = np.minimum(least, ((hashes[None, k : k + 4096] ^ mask) * odd).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, n_shingles, _set (digest of the set of shingles), _sig."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_sig", T.ArrayType(T.IntegerType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles")
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
                sigs = np.concatenate([signature(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.ListArray.from_arrays(np.arange(0, len(sigs) + 1, COORDINATES, dtype=np.int32), pa.array(sigs, pa.int32()))], names=schema.names
                )

    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sets_of(docs: DataFrame, ids: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """The whole sets of shingles of the classes ids: _id, _hashes. Only the texts of their smallest documents are read again."""
    schema = T.StructType([T.StructField("_id", T.BinaryType()), T.StructField("_hashes", T.ArrayType(T.LongType()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles")
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                sets = [shingles(t, n) for t in whole.slice(start, 64).column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], names=schema.names)

    chosen = cut(classes.join(ids, "_id", "left_semi").select("_doc").distinct())
    return join_checked(docs.select(F.col("doc_id").alias("_doc"), "text"), chosen, "_doc", "left_semi", BROADCAST).mapInArrow(make, schema)


def lost(matches: int = MATCHES, percent: int = 80) -> float:
    """The probability that two sets of the similarity percent share fewer than matches coordinates, each with that probability."""
    p = percent / 100
    return sum(math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(matches))


def with_star(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """pairs (_id, _star, _copies) with side's columns, whose key is _star.

    A star may meet a third of all rows, so its row comes in _copies copies and each pair takes one by a hash of _id.
    """
    copies = pairs.groupBy("_star").agg(F.max("_copies").alias("_copies"))
    copied = side.join(copies, "_star").withColumn("_salt", F.explode(F.expr("sequence(0L, _copies - 1)"))).drop("_copies")
    return pairs.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_copies"))).join(copied, ["_star", "_salt"]).drop("_salt")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs _id, _star whose whole sets are similar enough, as links _a, _b."""
    ids = pairs.select("_id").union(pairs.select("_star")).distinct()
    sets = cut(sets_of(docs, ids, classes, n))
    both = with_star(pairs, sets.select(F.col("_id").alias("_star"), F.col("_hashes").alias("_other"))).join(sets, "_id")
    both = both.withColumn("_inter", F.size(F.array_intersect("_hashes", "_other")).cast("long"))
    union = F.size("_hashes") + F.size("_other") - F.col("_inter")
    return cut(both.filter(100 * F.col("_inter") >= percent * union).select(F.least("_id", "_star").alias("_a"), F.greatest("_id", "_star").alias("_b")).distinct())


def merged(links: DataFrame, held: int) -> DataFrame:
    """As few links _a, _b that join the same ids: each HELD links of a task become stars around their least ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            up = root.setdefault(x, x)
            while up != root[up]:
                root[x] = up = root[up]
            return up

        def stars(schema: pa.Schema) -> pa.RecordBatch:
            ends = [(find(x), x) for x in list(root)]
            root.clear()
            return pa.RecordBatch.from_pylist([{"_a": r, "_b": x} for r, x in ends if r != x], schema)

        for batch in batches:
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b")), strict=True):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if len(root) >= held:
                    yield stars(batch.schema)
        if root:
            yield stars(batch.schema)

    narrow = links.select("_a", "_b")
    return narrow.mapInArrow(each, narrow.schema)


def components(links: DataFrame, held: int = HELD, trace: list | None = None) -> DataFrame:
    """_id and _component, the least id that it is linked with over any way, of all that the links _a, _b hold.

    Large-star and small-star steps alternate: all neighbours above an id are linked to the least one around it, then all
    below it are; the number of rounds grows with the logarithm of the longest way, whatever the order of ids. Before that
    each task merges what it holds. Links are counted and gathered in as many tasks as held goes into them, whatever the
    session shuffles to, so that few links settle at once. Every round is written to the checkpoint folder; trace takes
    in the links of each.
    """
    links = cut(links.filter("_a != _b").select("_a", "_b").distinct())
    tasks = max(1, math.ceil(links.count() / held))
    edges = cut(merged(links.coalesce(tasks), held))
    while True:
        ends = edges.select(F.col("_b").alias("_id"), F.col("_a").alias("_up"), F.lit(False).alias("_down")).union(edges.select("_a", F.lit(None), F.lit(True)))
        if trace is not None:
            trace.append(edges.count())
        ends = ends.groupBy("_id").agg(F.min("_up").alias("_low"), F.max("_up").alias("_high"), F.bool_or("_down").alias("_down"))
        if ends.filter("_low != _high OR (_low IS NOT NULL AND _down)").isEmpty():
            return cut(edges.select(F.col("_b").alias("_id"), F.col("_a").alias("_component")).union(edges.select("_a", "_a")).distinct())
        least = cut(edges.groupBy(F.col("_b").alias("_a")).agg(F.min("_a").alias("_least")))
        large = cut(join_checked(edges, least, "_a", "left", BROADCAST).select(F.coalesce("_least", "_a").alias("_a"), "_b"))
        least = cut(large.groupBy("_b").agg(F.min("_a").alias("_least")))
        below = large.join(least, "_b").filter("_a != _least").select(F.col("_least").alias("_a"), F.col("_a").alias("_b"))
        edges = cut(merged(cut(below.union(least.select("_least", "_b")).distinct()).coalesce(tasks), held))


def posted(classes: DataFrame, matches: int) -> DataFrame:
    """Inverted lists _key, _id, _central, _mask: each class under the rarest of its coordinate-value pairs.

    Two signatures with at least matches pairs in common share one of the rarest COORDINATES - matches + 1 of either, so
    a class is posted under these only: the pairs that many documents hold come last and their long lists are skipped.
    Pairs that no other class holds need no list, and classes that share fewer than matches pairs with others at all
    are left out. _central: how widely the class's pairs are shared, larger the more of the list it resembles.
    _mask: the coordinates that the class is posted under, as bits.
    """
    every = classes.select("_id", F.posexplode("_sig").alias("_k", "_value"))
    every = every.select("_id", (F.col("_k").cast("long") * F.lit(2**32) + F.col("_value")).alias("_key"))
    shared = every.groupBy("_key").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    own = every.join(shared, "_key").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_df", "_key"))).alias("_pairs"), F.sum("_df").alias("_central"))
    own = own.filter(F.size("_pairs") >= matches)
    rare = F.slice("_pairs", F.lit(1), F.size("_pairs") - F.lit(matches - 1))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), coordinate(p["_key"]).cast("int"))
    mask = F.aggregate(rare, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(bit(p)))
    own = own.select("_id", "_central", mask.alias("_mask"), F.explode(rare).alias("_pair"))
    return own.select("_id", "_central", "_mask", F.col("_pair._key").alias("_key"))


def coordinate(key: Column) -> Column:
    """The coordinate of a coordinate-value pair; values are signed."""
    return F.floor((key + F.lit(2**31)) / F.lit(2**32))


def alike(pairs: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Those of the pairs _id, _star whose signatures collide in at least matches coordinates and whose sizes allow the similarity."""
    stars = classes.select(F.col("_id").alias("_star"), F.col("_sig").alias("_other"), F.col("n_shingles").alias("_size"))
    both = with_star(pairs, stars).join(classes.select("_id", "_sig", "n_shingles"), "_id")
    same = F.aggregate(F.zip_with("_sig", "_other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("n_shingles", "_size") >= percent * F.greatest("n_shingles", "_size")
    return both.filter((same >= matches) & fits).select("_id", "_star", "_copies")


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets a and b, pair by pair; many pairs come from products of incidence matrices."""
    if len(a) <= SINGLY:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, columns, counts = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(used), len(used)), np.float32)  # exact: sums of ones below 2 ** 24
    edges = np.searchsorted(columns, np.arange(0, columns[-1] + 1 + COLUMNS, COLUMNS)) if len(columns) else [0]
    for low, high in zip(edges, edges[1:], strict=False):
        block = np.zeros((len(used), COLUMNS), np.float32)
        block[rows[low:high], columns[low:high] % COLUMNS] = 1
        total += block @ block.T
    return total[at[: len(a)], at[len(a) :]].astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links a, b among n members: a parent and its children, again and again."""
    near = np.zeros((n, n), bool)
    near[a, b] = near[b, a] = True
    left = near.any(axis=1)
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue:
            parent = queue.pop()
            children = np.flatnonzero(near[parent] & left)
            if len(children):
                left[children] = False
                queue.extend(children.tolist())
                yield parent, children


def rest(lists: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, n: int, matches: int, percent: int) -> DataFrame:
    """Links _a, _b between members of one list that no way links yet: enough of them that every linked pair is linked in some way.

    Lists whose members are all linked are done. The others are dealt out by blocks of about BLOCK members and compared
    block against block, so that no task holds a list. Signatures choose first, and the whole sets of the members they
    leave are fetched; these decide inside the task, and only a spanning forest of the links leaves it: fewer rows than
    members, however many are alike.
    """
    held = lists.join(labels, "_id", "left").select("_key", "_id", "_mask", F.coalesce("_component", "_id").alias("_component"))
    open_ = held.groupBy("_key").agg(F.min("_component").alias("_low"), F.max("_component").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low != _high")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("long")
    rows = cut(held.join(open_, "_key").withColumn("_blocks", blocks).select("_key", "_id", "_mask", "_component", "_blocks", F.pmod(F.xxhash64("_id"), F.col("_blocks")).alias("_block")))
    rows = rows.withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    rows = rows.select("_key", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", "_id", "_mask", "_component")
    rows = rows.join(classes.select("_id", "_sig", F.col("n_shingles").alias("_size")), "_id")
    places = T.StructType([*(T.StructField(c, T.LongType()) for c in ("_key", "_i", "_j")), T.StructField("_id", T.BinaryType())])
    schema = T.StructType([T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def candidates(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows with different labels whose signatures and sizes are near enough.

        A pair is due in one list only, that of the first coordinate under which both are posted with the same value.
        """
        sigs = table.column("_sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, COORDINATES)
        label = table.column("_component").combine_chunks().dictionary_encode().indices.to_numpy()
        block, size, mask = (table.column(c).to_numpy() for c in ("_block", "_size", "_mask"))
        bits = (mask[:, None] >> np.arange(COORDINATES)) & 1 == 1
        here = (table.column("_key")[0].as_py() + 2**31) >> 32
        across, found = table.column("_i")[0].as_py() != table.column("_j")[0].as_py(), []
        for k in range(table.num_rows - 1):
            near = (label[k + 1 :] != label[k]) & (100 * np.minimum(size[k + 1 :], size[k]) >= percent * np.maximum(size[k + 1 :], size[k]))
            if across:
                near &= block[k + 1 :] != block[k]
            other = np.flatnonzero(near) + k + 1
            same = sigs[other] == sigs[k]
            at = same.sum(axis=1) >= matches
            other, same = other[at], same[at]
            other = other[(same & bits[other] & bits[k]).argmax(axis=1) == here]
            if len(other):
                found.append((np.full(len(other), k), other))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2

    def sift(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate(candidates(table)))
        if len(at):
            yield from table.select(places.names).take(pa.array(at)).combine_chunks().to_batches()

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = candidates(table)
        if not len(a):
            return
        ids, size = (table.column(c).to_numpy() for c in ("_id", "_size"))
        lists = table.column("_hashes").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
        inter = intersections([flat[x:y] for x, y in zip(ends, ends[1:], strict=False)], a, b)
        good = 100 * inter >= percent * (size[a] + size[b] - inter)
        for parent, children in forest(table.num_rows, a[good], b[good]):
            ends = [sorted((ids[parent], ids[k])) for k in children]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*ends, strict=True)], names=["_a", "_b"])

    def dealt(rows: DataFrame, function, schema) -> DataFrame:
        """function over the rows of each block pair of each list."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_over("pairs")
            held, key = [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("_key", "_i", "_j")])
                starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for start, stop in zip(starts, starts[1:], strict=False):
                    if stop > start:
                        now = keys[:, start].tolist()
                        if held and now != key:
                            yield from function(pa.Table.from_batches(held))
                            held = []
                        key = now
                        held.append(batch.slice(start, stop - start))
            if held:
                yield from function(pa.Table.from_batches(held))

        return rows.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j").mapInArrow(each, schema)

    left = cut(dealt(rows, sift, places))
    sets = cut(sets_of(docs, left.select("_id").distinct(), classes, n))
    rows = rows.join(left, ["_key", "_i", "_j", "_id"], "left_semi").join(sets, "_id")
    return dealt(rows, compare, schema).distinct()


def linked(docs: DataFrame, n: int = 5, percent: int = 80, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """What near_duplicates() and deduplicated() rest on: rows doc_id, n_shingles, _set; and labels _set, _component for all sets that several documents hold or that are linked."""
    rows = cut(signed(docs, n))
    held = rows.filter(F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(held.groupBy(F.col("_set").alias("_id")).agg(F.min("doc_id").alias("_doc"), F.first("_sig").alias("_sig"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("_copies")))
    lists = cut(posted(classes, matches))
    ranked = (F.struct("_central", "_id"), *(F.struct(F.xxhash64("_id", F.lit(k)), "_id") for k in range(2)))
    stars = lists.groupBy("_key").agg(F.array_distinct(F.array(*(F.max_by("_id", r) for r in ranked))).alias("_stars"), F.ceil(F.count(F.lit(1)) / DEALT).cast("long").alias("_copies"))
    near = lists.join(stars, "_key").select("_id", F.explode("_stars").alias("_star"), "_copies").filter("_star != _id")
    near = cut(near.groupBy("_id", "_star").agg(F.max("_copies").alias("_copies")))
    links = confirmed(cut(alike(near, classes, matches, percent)), classes, docs, n, percent)
    labels = components(links)
    more = cut(rest(lists, labels, classes, docs, n, matches, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    found = classes.select("_id", "_doc", "_copies").join(labels, "_id", "left").filter("_copies > 1 OR _component IS NOT NULL")
    found = cut(found.withColumn("_component", F.coalesce("_component", "_id")))
    least = cut(found.groupBy("_component").agg(F.min("_doc").alias("_least")))
    return rows.drop("_sig"), cut(join_checked(found, least, "_component", "inner", BROADCAST).select(F.col("_id").alias("_set"), F.col("_least").alias("_component")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept (doc_id = component_id).

    Documents with equal sets of n-word shingles (A-Z lower-cased) are one class, of which one member is compared.
    Classes are linked when their sets' similarity is percent or more, on whole sets. Each inverted list's members are
    compared with three of them first, the most central one and two others, so that a large group is linked without
    its pairs; then what is not linked yet is compared block by block, so no link between different texts is lost but for
    those below matches collisions: lost(matches, percent) of those at the threshold, 2e-8 by default, fewer above it.
    A smaller matches loses fewer and posts each class under more pairs (COORDINATES - matches + 1).

    Null, empty and blank texts have no shingles and link with nothing. Texts of any length are taken whole. Repeated
    rows and rows with the same doc_id count as one document. doc_id may be of any type with an order; a null one takes no
    part: its component is null and it is kept. Other columns are not read, whatever their names. An empty table gives none.
    """
    rows, labels = linked(docs, n, percent, matches)
    return named(rows, labels).drop("_set")


def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """linked()'s rows with component_id and kept."""
    out = join_checked(rows, labels, "_set", "left", BROADCAST)
    component = F.when(F.col("n_shingles") > 0, F.coalesce(F.least("_component", "doc_id"), "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "_set")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """docs' rows and columns without the near-duplicates of others: of each group the document with the smallest doc_id stays, in one row.

    Null, empty and blank texts and rows without a doc_id stay. Where rows with one doc_id have different texts, each is
    judged by its own; rows of one doc_id with equal sets of shingles are one. Columns that n_shingles, kept or other names
    of these operators clash with stay as they are. An empty table gives none.
    """
    rows, labels = linked(docs, n, percent, matches)
    found = cut(named(rows, labels).filter("doc_id IS NOT NULL"))
    several = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("kept").alias("_kept"))
    gone = several.filter("_n = 1 AND NOT _kept").select(F.col("doc_id").alias("_gone"))
    left = join_checked(docs, cut(gone), docs["doc_id"] == F.col("_gone"), "left_anti", BROADCAST)
    again = cut(several.filter("_n > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return left
    once = join_checked(left, again, left["doc_id"] == F.col("_again"), "left_anti", BROADCAST)
    more = join_checked(docs, again, docs["doc_id"] == F.col("_again"), "left_semi", BROADCAST)
    carried = more.select(F.struct(*more.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    schema = T.StructType([*carried.schema.fields, T.StructField("_digest", T.BinaryType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles")
        for batch in batches:
            of = [digest(shingles(t, n)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.binary())], names=schema.names)

    kept = found.filter("kept").select(F.col("doc_id"), F.col("_set").alias("_digest")).distinct()
    chosen = carried.mapInArrow(digests, schema).join(kept, ["doc_id", "_digest"]).groupBy("doc_id", "_digest").agg(F.min_by("_row", F.coalesce("text", F.lit(""))).alias("_row"))
    return once.unionByName(chosen.select("_row.*"))
