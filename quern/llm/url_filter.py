"""URL filters: rules on hosts and paths, else gradient-boosted trees on lexical features; DataFrame functions only."""

from __future__ import annotations

import json
import math
import string
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words that mark a host as one to block in weak_labels().
SEEDS = ("adult", "bet", "bets", "casino", "escort", "gambling", "loans", "lottery", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: The parameter sample: at most so many labelled URLs are learnt from, those of the smallest hashes.
SAMPLE = 20_000
#: URLs are dealt to so many folds by a hash; those of the first one are held out of the training.
FOLDS = 5
TREES, DEPTH, RATE, BINS, SHRINK = 24, 3, 0.3, 32, 1.0
#: Rows that a suffix's statistics need before they outweigh the overall share.
PRIOR = 10
NUMBERS = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "params", "hyphens")
#: What shares of blocks are counted of: the host's last label and last two, and the path's first segment.
SUFFIXES = ("_suffix1", "_suffix2", "_segment")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that decides and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def entropy(s: Column) -> Column:
    """Bits per character, by the runs of the sorted characters: one pass over whole strings of any length."""
    chars = F.array_sort(F.split(s, ""))
    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    term = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1.0).otherwise(1.0).alias("n"), F.when(same, a["sum"]).otherwise(a["sum"] + term(a["n"])).alias("sum"))

    n = F.length(s).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, zero, step, lambda a: a["sum"] + term(a["n"])) / n).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    length = F.length(u).cast("double")
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
        "digit_ratio": F.when(length > 0, (length - F.length(F.translate(u, string.digits, ""))) / length).otherwise(0.0),
        "entropy": F.round(entropy(u), 6),
        "params": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-")))).cast("double"),
        "_suffix1": F.substring_index(host, ".", -1),
        "_suffix2": F.substring_index(host, ".", -2),
        "_segment": F.regexp_extract(path, "^/([^/]*)/", 1),
    }


def grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A tree over binned rows: (feature, threshold, low, high), or a leaf's value. Takes the split of the largest gain."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, found = 1e-9, None
    for k in range(x.shape[1]) if depth and len(rows) > 1 else ():
        left_g = np.cumsum(np.bincount(x[rows, k], g[rows], len(edges[k]) + 1))[:-1]
        left_h = np.cumsum(np.bincount(x[rows, k], h[rows], len(edges[k]) + 1))[:-1]
        gain = left_g**2 / (left_h + SHRINK) + (total_g - left_g) ** 2 / (total_h - left_h + SHRINK) - total_g**2 / (total_h + SHRINK)
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (k, int(gain.argmax()))
    if found is None:
        return float(-RATE * total_g / (total_h + SHRINK))
    k, cut = found
    low = x[rows, k] <= cut
    return k, float(edges[k][cut]), grow(x, edges, g, h, rows[low], depth - 1), grow(x, edges, g, h, rows[~low], depth - 1)


def apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, threshold, low, high = tree
    return np.where(x[:, k] <= threshold, apply(low, x), apply(high, x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting with the logistic loss: the first score and the trees."""
    if not len(y):
        return 0.0, []
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    first = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    score, trees = np.full(len(y), first), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH))
        score = score + apply(trees[-1], x)
    return first, trees


def expression(tree, columns: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    k, threshold, low, high = tree
    return F.when(columns[k] <= threshold, expression(low, columns)).otherwise(expression(high, columns))


def literal_table(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def fold(url: Column) -> Column:
    return F.crc32(url.cast("binary")) % FOLDS


def weak_labels(urls: DataFrame) -> DataFrame:
    """url and label: 1 if the host has a word of SEEDS between its dots and hyphens."""
    host, _ = parts(F.col("url"))
    return urls.select("url", F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, SEEDS))).cast("int").alias("label"))


@dataclass(frozen=True)
class Model:
    """first: the score without trees; shares: of blocks for each suffix."""

    first: float
    trees: list
    shares: dict[str, dict[str, float]]


def share(counts: list[tuple[float, int]], overall: float) -> float:
    """The share of blocks, drawn to the overall one; 0 without any count, as nothing is known against such a suffix."""
    if not any(n for _, n in counts):
        return 0.0
    return (sum(b for b, _ in counts) + PRIOR * overall) / (sum(n for _, n in counts) + PRIOR)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Trees from labelled URLs (url, label with 1 for block) outside of the held-out fold, at most sample of them.

    A suffix's share of blocks is out of fold where trees learn from it: it is counted over the URLs of all other folds,
    so that no URL's own label is its feature. What is scored later gets the share over all folds learnt from.
    """
    host, path = parts(F.col("url"))
    known = labelled.filter("url IS NOT NULL AND label IS NOT NULL").withColumn("_fold", fold(F.col("url"))).filter("_fold != 0")
    chosen = known.groupBy("url", "_fold").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = sorted(chosen.select("url", "_fold", "label", *(c.alias(n) for n, c in features(F.col("url"), host, path).items())).collect(), key=lambda r: r["url"])
    y = np.array([float(r["label"]) for r in rows])
    overall = float(y.mean()) if len(y) else 0.5
    shares, columns = {}, [[float(r[n]) for r in rows] for n in NUMBERS]
    for name in SUFFIXES:
        seen = defaultdict(lambda: [(0.0, 0)] * FOLDS)
        for r in rows:
            b, n = seen[r[name]][r["_fold"]]
            seen[r[name]][r["_fold"]] = (b + r["label"], n + 1)
        columns.append([share([c for k, c in enumerate(seen[r[name]]) if k != r["_fold"]], overall) for r in rows])
        shares[name] = {s: share(counts, overall) for s, counts in seen.items()}
    first, trees = boost(np.array(columns, float).T.reshape(len(rows), len(columns)), y)
    return Model(first, trees, shares)


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), block_score (probability of block by the trees), held_out.

    The rule that fits decides; where none fits, gradient-boosted trees on lexical features do. They learn from
    labelled (url, label: 1 for block): at most sample different URLs, by hash, without those held out. By default these
    are the pages' own URLs that a rule decides; what no rule decides is then judged by what it looks like among these.
    weak_labels() gives others. Trees become CASE expressions, so scoring is one scan; the suffix statistics, of at most
    sample suffixes, are broadcast.

    A null URL or one without :// has an empty host and path, fits no rule and is scored like an empty one. Without
    labelled URLs all scores are 0.5, which allows. URLs of any length are taken whole. Repeated rows are judged alike,
    whatever their page_id. Other columns than page_id and url are not read, whatever their names. An empty table gives none.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "_ruled": verdict})
    if labelled is None:
        labelled = rows.select("url", (F.col("_ruled") == "block").cast("int").alias("label"))
    model = fit(labelled, sample)
    made = features(F.col("url"), F.col("host"), F.col("path"))
    held = F.coalesce(fold(F.col("url")) == 0, F.lit(False))
    rows = rows.select("page_id", "host", "path", "rule", "_ruled", held.alias("held_out"), *(c.alias(f"_f_{n}") for n, c in made.items()))
    for name, shares in model.shares.items():
        found = literal_table(spark, [{f"_f_{name}": s, f"_share{name}": v} for s, v in shares.items()], f"`_f_{name}` string, `_share{name}` double")
        rows = rows.join(F.broadcast(found), f"_f_{name}", "left")
    columns = [*(F.col(f"_f_{n}") for n in NUMBERS), *(F.coalesce(F.col(f"_share{n}"), F.lit(0.0)) for n in model.shares)]
    score = sum((expression(t, columns) for t in model.trees), F.lit(model.first))
    judged = F.coalesce("_ruled", F.when(F.col("_score") > 0, "block").otherwise("allow"))
    return rows.withColumn("_score", score).select("page_id", "host", "path", "rule", judged.alias("verdict"), (1 / (1 + F.exp(-F.col("_score")))).alias("block_score"), "held_out")
