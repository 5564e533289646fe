"""Knowledge search: fuzzy matches over terms, rules and templates, federated results, chunks, redaction, incremental indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Redaction patterns in their order, and what they leave: fixed values.
REDACTIONS = (
    (r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']""", "***REDACTED***"),
    (r"""(?i)(secret|password|passwd|pwd)\s*[:=]\s*["'][^"']{4,}["']""", "***REDACTED***"),
    (r"""(?i)(token|access[_-]?token)\s*[:=]\s*["'][A-Za-z0-9_\-\.]{16,}["']""", "***REDACTED***"),
    (r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+PRIVATE KEY-----", "***REDACTED***"),
    (r"""(?i)(aws[_-]?secret[_-]?access[_-]?key)\s*[:=]\s*["'][A-Za-z0-9/+=]{40}["']""", "***REDACTED***"),
    (r"(?i)(bearer)\s+[A-Za-z0-9_\-\.]{20,}", "***REDACTED***"),
    (r"(?i)(mongodb|postgres|mysql|redis)://[^:\s]+:[^@\s]+@", "***REDACTED***"),
)


def redact(text: Column) -> Column:
    for pattern, left in REDACTIONS:
        text = F.regexp_replace(text, pattern, left)
    return text


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def fuzzy(a: Column, b: Column) -> Column:
    """Both of two bytes or more, and a pair of neighbouring characters in common."""
    return (F.octet_length(a) >= 2) & (F.octet_length(b) >= 2) & F.arrays_overlap(bigrams(a), bigrams(b))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def search_terms(terms: DataFrame, query: str, name: str = "name", definition: str = "definition", aliases: str | None = "aliases") -> DataFrame:
    q = F.lit(query)
    hit = either_contains(F.col(name), q) | F.contains(F.col(definition), q) | fuzzy(F.col(name), q) | fuzzy(F.col(definition), q)
    if aliases:
        hit = hit | F.exists(F.col(aliases), lambda x: fuzzy(x, q))
    return terms.filter(hit)


def search_rules(rules: DataFrame, query: str, name: str = "name", definition: str = "definition", scene: str = "scene") -> DataFrame:
    q = F.lit(query)
    return rules.filter(either_contains(F.col(name), q) | F.contains(F.col(definition), q) | F.contains(F.col(scene), q) | fuzzy(F.col(name), q) | fuzzy(F.col(definition), q))


def search_templates(templates: DataFrame, query: str, name: str = "name", fields: str = "fields") -> DataFrame:
    q = F.lit(query)
    field = F.exists(F.col(fields), lambda f: either_contains(f["name"], q) | F.contains(f["meaning"], q) | fuzzy(f["meaning"], q))
    return templates.filter(either_contains(F.col(name), q) | fuzzy(F.col(name), q) | field)


def federated(sources: list[tuple[str, DataFrame]], k: int, most: int = 50) -> DataFrame:
    """source, id, score, content of all sources in their order; k results at most, by source, score and id. Sources give id, score, content."""
    k = min(max(k, 1), most)
    out = None
    for place, (name, df) in enumerate(sources):
        one = df.select(F.lit(place).alias("_place"), F.lit(name).alias("source"), "id", F.col("score").cast("double").alias("score"), "content")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("_place", F.desc("score"), "id").limit(k).select("source", "id", "score", "content")


def low_recall(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score")).withColumn("low_recall", F.col("top_score") < threshold)


def valid_sources(rules: DataFrame, files: DataFrame, path: str = "path", first: str = "line_start", last: str = "line_end") -> DataFrame:
    """rules with valid: the file exists (files: path, lines) and has the lines."""
    ok = F.col("lines").isNotNull() & (F.col(first) >= 1) & (F.col(first) <= F.col(last)) & (F.col(last) <= F.col("lines"))
    return rules.join(files, path, "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("lines")


#: What the first words of a line, after blanks, say about the symbol that it begins: fixed values.
SYMBOLS = {
    "Function": ("fn ", "pub fn ", "async fn ", "pub async fn ", "pub(crate) fn "),
    "Struct": ("struct ", "pub struct ", "pub(crate) struct "),
    "Trait": ("trait ", "pub trait "),
    "Mod": ("mod ", "pub mod "),
    "Impl": ("impl ", "impl<"),
    "Enum": ("enum ", "pub enum "),
    "Const": ("const ", "pub const "),
    "Static": ("static ", "pub static "),
}


def symbol_of(line: str) -> str | None:
    return next((kind for kind, starts in SYMBOLS.items() if line.lstrip().startswith(starts)), None)


def chunk_text(text: str | None, most: int) -> Iterator[tuple[int, int, str, str]]:
    """First line, last line, symbol and text of each chunk; blank ones are dropped.

    A chunk ends before each line that begins a symbol, and after the line with which it has most bytes or more (at
    least 200); what follows such a full one has no symbol. Lines count from 1, but a text that doesn't begin with a
    symbol has its first chunk at 0.
    """
    most = max(most, 200)
    every = (text or "").split("\n")
    every = [x.removesuffix("\r") for x in (every[:-1] if every[-1] == "" else every)]
    cuts = [(0, 0, "Other")]  # before which line, the first line's number, the symbol
    size = 0
    for k, line in enumerate(every):
        if kind := symbol_of(line):
            cuts.append((k, k + 1, kind))
            size = 0
        size += len(line.encode("utf-8", "surrogatepass")) + 1
        if size >= most:
            cuts.append((k + 1, k + 2, "Other"))
            size = 0
    for (at, first, kind), (end, _, _) in zip(cuts, [*cuts[1:], (len(every), 0, "")], strict=True):
        body = "".join(f"{x}\n" for x in every[at:end])
        if body.strip():
            yield first, end, kind, body


def chunks(docs: DataFrame, key: str, text: str, most: int = 1500) -> DataFrame:
    """key, line_start, line_end, symbol, chunk; sequential in each document, so in Arrow batches, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *c) for k, t in zip(f[key], f[text], strict=True) for c in chunk_text(t, most)]
            yield pd.DataFrame(rows, columns=[key, "line_start", "line_end", "symbol", "chunk"])

    return docs.select(key, text).mapInPandas(each, f"{key} {kind}, line_start int, line_end int, symbol string, chunk string")


def not_done(items: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """What the journal doesn't call done yet."""
    return items.join(journal.filter("status = 'success'").select(key), key, "left_anti")


def vectorize(items: DataFrame, journal: DataFrame, key: str, text: str, embed) -> tuple[DataFrame, DataFrame]:
    """The vectors of what is not done yet, redacted first, and the rows that go to the journal."""
    new = not_done(items, journal, key).withColumn(text, redact(F.col(text)))
    return new.withColumn("vector", embed(F.col(text))), new.select(key, F.lit("success").alias("status"))


def first_seen(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The cap newest rows, then of each key the first of these."""
    newest = df.orderBy(*order).limit(cap)
    return newest.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
