"""Line dedup with a log-template tree: lines whose template recurs across documents are dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_checked
from .near_dup import components

SLICE = 512
#: Leading tokens on the way to a leaf; a line of fewer than SHORT tokens is a leaf and a template of its own, which only equal lines join.
DEPTH, SHORT = 3, 6
#: A template recurs if it is in so many different documents.
DOCUMENTS = 3
#: At most one place of so many is generalised to a field.
PLACES = 5
BROADCAST = 200_000
FIELD = b"<*>"
DIGIT = re.compile(rb"\d")
DIGITS = b"0123456789"


def hashed(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - 2**63


def masked(words: list[bytes], line: bytes) -> list[bytes]:
    """The tokens of a line; those with a digit are fields."""
    if len(line.translate(None, DIGITS)) == len(line):
        return words
    return [FIELD if DIGIT.search(w) else w for w in words]


def parsed(text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """Place, hash, leaf and hash with digits of each line with a token.

    A short line that has nothing but fields is no template: it is told by its digits.
    """
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n") if text else ()):
        words = line.split()
        if not words:
            continue
        told = hashed(b" ".join(words))
        tokens = masked(words, line)
        h = told if tokens is words else hashed(b" ".join(tokens))
        if len(words) >= SHORT:
            yield k, h, hashed(b"%d " % len(words) + b" ".join(tokens[:DEPTH])), told
        elif tokens is not words and tokens == [FIELD] * len(tokens):
            yield k, told, told, told
        else:
            yield k, h, h, told


def lines(docs: DataFrame) -> DataFrame:
    """Per line with a token: _doc, doc_id, _class (alike for documents with equal lines, in any order), _at, _line, _leaf."""
    schema = T.StructType([T.StructField("_doc", T.LongType()), docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("_class", "_at", "_line", "_leaf"))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                row, kind, at, line, leaf = [], [], [], [], []
                for k, text in enumerate(batch.column(2).to_pylist()):
                    found = list(parsed(text))
                    total = sum(f[3] for f in found) % 2**64 - 2**63
                    for place, h, key, _ in found:
                        row.append(k), kind.append(total), at.append(place), line.append(h), leaf.append(key)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(2)), *(pa.array(x, pa.int64()) for x in (kind, at, line, leaf))], names=schema.names)

    return docs.select(F.xxhash64("doc_id", "text").alias("_doc"), "doc_id", "text").mapInArrow(each, schema)


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The masked tokens of the lines at the places (_doc, _places): _line, _leaf, _masked."""
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("_line", "_leaf")), T.StructField("_masked", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch, seen = whole.slice(start, SLICE), {}
                for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    every = text.encode("utf-8", "surrogatepass").split(b"\n")
                    for line in (every[k] for k in at):
                        tokens = masked(words := line.split(), line)
                        seen[b" ".join(tokens)] = hashed(b"%d " % len(words) + b" ".join(tokens[:DEPTH]))
                yield pa.RecordBatch.from_arrays([pa.array(map(hashed, seen), pa.int64()), pa.array(seen.values(), pa.int64()), pa.array([t.decode("utf-8", "replace") for t in seen], pa.string())], names=schema.names)

    found = join_checked(docs.select(F.xxhash64("doc_id", "text").alias("_doc"), "text"), places, "_doc", "inner", BROADCAST)
    return found.select("text", "_places").mapInArrow(each, schema).groupBy("_line", "_leaf").agg(F.min("_masked").alias("_masked"))


def generalised(different: DataFrame, documents: DataFrame) -> DataFrame:
    """_line, _leaf, _general and _tokens: the lines with their rare tokens turned to fields.

    documents: the different documents (_n) of each line. A token is rare if the lines of the leaf that have it at that
    place are in fewer than DOCUMENTS documents, counted line by line, which are two lines at most. A line of which more
    than one place in PLACES is rare stays as it is.
    """
    tokens = different.join(documents, "_line").select("_line", "_leaf", "_n", F.posexplode(F.split("_masked", " ")).alias("_at", "_token"))
    tokens = tokens.filter(F.col("_token") != FIELD.decode())
    rare = tokens.groupBy("_leaf", "_at", "_token").agg(F.sum("_n").alias("_n"), F.min("_line").alias("_low"), F.max("_line").alias("_high")).filter(F.col("_n") < DOCUMENTS)
    rare = rare.select("_at", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_line")).groupBy("_line").agg(F.collect_set("_at").alias("_rare"))
    rows = different.join(rare, "_line", "left").withColumn("_tokens", F.split("_masked", " "))
    free = F.transform("_tokens", lambda t, k: F.when(F.array_contains("_rare", k), FIELD.decode()).otherwise(t))
    rows = rows.withColumn("_tokens", F.when(F.size("_rare") * PLACES <= F.size("_tokens"), free).otherwise(F.col("_tokens")))
    return rows.select("_line", "_leaf", F.xxhash64("_leaf", F.array_join("_tokens", " ")).alias("_general"), "_tokens")


def templates(different: DataFrame, documents: DataFrame) -> DataFrame:
    """_line and _template. Lines of a leaf that generalise to the same tokens, or to tokens alike at all places but one, or are linked by others that do, have one template."""
    rows = cut(generalised(different, documents))
    kinds = rows.groupBy("_general", "_leaf").agg(F.first("_tokens").alias("_tokens"))
    each = F.transform("_tokens", lambda t, k: F.xxhash64(t, k))
    kinds = kinds.withColumn("_hashes", each).withColumn("_all", F.aggregate("_hashes", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h)))
    but_one = kinds.select("_general", "_leaf", "_all", F.posexplode("_hashes").alias("_at", "_hash")).filter(F.col("_at") >= DEPTH)
    but_one = cut(but_one.select("_general", F.xxhash64("_leaf", "_at", F.col("_all").bitwiseXOR(F.col("_hash"))).alias("_rest")))
    shared = cut(but_one.groupBy("_rest").agg(F.min("_general").alias("_a"), F.max("_general").alias("_b")).filter("_a != _b").select("_rest", "_a"))
    links = join_checked(but_one, shared, "_rest", "inner", BROADCAST).filter("_a != _general").select("_a", F.col("_general").alias("_b"))
    found = components(links).withColumnRenamed("_id", "_general")
    return join_checked(rows.select("_line", "_general"), found, "_general", "left", BROADCAST).select("_line", F.coalesce("_component", "_general").alias("_template"))


def repeated(docs: DataFrame) -> DataFrame:
    """The lines to drop: _doc and _drop, their places in it."""
    found = cut(lines(docs))
    leaves = found.groupBy("_leaf", "_class").agg(F.lit(1).alias("_one")).groupBy("_leaf").agg(F.count("_one").alias("_n"))
    leaves = cut(leaves.filter(F.col("_n") >= DOCUMENTS).select("_leaf"))
    found = cut(join_checked(found, leaves, "_leaf", "left_semi", BROADCAST))
    long = found.filter("_line != _leaf")
    chosen = long.groupBy("_line").agg(F.min(F.struct("_doc", "_at")).alias("_first"))
    places = cut(chosen.groupBy(F.col("_first._doc").alias("_doc")).agg(F.collect_set("_first._at").alias("_places")))
    documents = long.groupBy("_line", "_class").agg(F.lit(1).alias("_one")).groupBy("_line").agg(F.count("_one").alias("_n"))
    joined = cut(templates(cut(texts_of(docs, places)), cut(documents)))
    named = join_checked(found, joined, "_line", "left", BROADCAST).withColumn("_template", F.coalesce("_template", "_line"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_class"))
    by_class = named.groupBy("_template", "_class").agg(first.alias("_first"))
    recurring = by_class.groupBy("_template").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
    recurring = cut(recurring.filter(F.col("_n") >= DOCUMENTS).select("_template", F.col("_first._class").alias("_kept")))
    gone = join_checked(named, recurring, "_template", "inner", BROADCAST).filter("_class != _kept")
    return cut(gone.groupBy("_doc").agg(F.collect_set("_at").alias("_drop")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs' rows and columns with the text, and n_chars if there is one, of what is left of it; and _lines, _dropped.

    Tokens are words; those with a digit are fields. A fixed-depth tree leads by the number of tokens and the DEPTH first
    ones to a leaf. In it, tokens that fewer than DOCUMENTS documents have at their place are fields too, if these are at
    most one place in PLACES; lines that then agree at all places, or at all but one, share a template, and so do those
    that others link. Lines of fewer than SHORT tokens are templates of their own, digits aside. All this is counted, not
    built line by line, so templates don't depend on an order and no task holds a leaf.

    A template recurs if it is in DOCUMENTS or more different documents, and is dropped from all but the one with the
    smallest doc_id (null last) and that one's equals. Documents are equal if their lines are, digits and all and as often,
    in any order; so a group of equal copies counts as one however large it is, and what only they hold stays for
    near-duplicate removal. Edited copies are different documents, and lose what they share with the first.

    Only lines of leaves that several documents reach are read again, each different one once, and only the places of
    dropped lines meet the texts.

    Null and empty texts and blank lines have nothing to drop. Texts and lines of any length are taken whole. Repeated
    rows, and rows that share a doc_id, are judged each by its own lines. Columns of docs named _lines and _dropped are
    replaced; all others stay as they are, whatever their names. An empty table gives none.
    """
    columns = [c for c in docs.columns if c not in ("_lines", "_dropped")]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c_{c}") for c in columns), F.xxhash64("doc_id", "text").alias("_doc"))
    rows = join_checked(rows, repeated(docs), "_doc", "left", BROADCAST)
    every = F.split("_c_text", "\n", -1)
    left = F.array_join(F.filter(every, lambda _, k: ~F.array_contains(F.col("_drop"), k.cast("long"))), "\n")
    made = {"_m_text": F.when(F.col("_drop").isNull(), F.col("_c_text")).otherwise(left)}
    if "n_chars" in columns:
        made["_m_n_chars"] = F.when(F.col("_drop").isNull(), F.col("_c_n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    made |= {"_m__lines": F.coalesce(F.size(every), F.lit(0)).cast("long"), "_m__dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    rows = rows.select(*(F.col(f"`_c_{c}`") for c in columns), *(v.alias(n) for n, v in made.items()))
    return rows.select(*(F.col(f"`_m_{c}`" if f"_m_{c}" in made else f"`_c_{c}`").alias(c) for c in (*columns, "_lines", "_dropped")))
