"""Retrieval: BM25, exact vector search, fusion, re-ranking, context budgets, memory."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates tokens, in a form that other engines read alike.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.transform(F.filter(F.split(text, SEPARATOR), lambda t: t != ""), F.lower)


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The index: term, key, tf, len; and its statistics n, avgdl, which count empty documents too."""
    split = docs.select(key, tokens(F.col(text)).alias("_t"))
    sized = split.withColumn("len", F.size("_t"))
    index = sized.select(key, "len", F.explode("_t").alias("term")).groupBy("term", key, "len").agg(F.count(F.lit(1)).alias("tf"))
    return index, sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def replace_documents(index: DataFrame, key: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index without removed documents and with added ones in place of their old selves."""
    for gone in (removed, added):
        if gone is not None:
            index = index.join(gone.select(key).distinct(), key, "left_anti").select(*index.columns)
    return index if added is None else index.unionByName(postings(added, key, "text")[0].select(*index.columns))


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the best k documents; repeated query tokens count repeatedly, documents without a match are none.

    The terms are known, so each document's counts of them come from one scan without exploding its tokens; the
    statistics are an aggregate of the same narrow rows.
    """
    words = [w for w in _tokenize(query)]
    if not words or k <= 0:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    terms = sorted(set(words))

    def times(word: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == word))

    split = docs.select(key, tokens(F.col(text)).alias("_t"))
    counted = split.select(key, F.size("_t").alias("_len"), *(times(w).alias(f"_tf{i}") for i, w in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    hit = counted.filter(" OR ".join(f"_tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))
    norm = F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("_len") / F.greatest(F.col("_avg"), F.lit(1.0)))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf, df = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0)
        score = score + words.count(w) * idf * tf * (k1 + 1) / (tf + norm)
    return hit.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def _tokenize(text: str) -> list[str]:
    out, word = [], ""
    for c in f"{text} ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word.lower())
            word = ""
    return out


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine (0 next to a norm under 1e-10), dot, or l2 (negated distance)."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
        return F.when((na < 1e-10) | (nb < 1e-10), 0.0).otherwise(dot(a, b) / (na * nb))
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.lit(0.0) - F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_top(vectors: DataFrame, key: str, column: str, query: list[float], k: int, metric: str = "cosine", tenant: tuple[str, object] | None = None) -> DataFrame:
    """Exact search by one query: the vector is a literal, so this is one scan and a top-k; an unknown tenant finds nothing."""
    if tenant is not None:
        vectors = vectors.filter(F.col(tenant[0]) == F.lit(tenant[1]))
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, similarity(F.col(column), wanted, metric).alias("score")).orderBy(F.desc("score"), key).limit(k)


def upsert(vectors: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key stays."""
    both = vectors.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").select(*vectors.columns)


def removed(vectors: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Without the vectors of the keys; those it doesn't have are no error."""
    return vectors.join(gone.select(*keys).distinct(), keys, "left_anti").select(*vectors.columns)


def retrieve(docs: DataFrame, key: str, text: str, words: str, vectors: DataFrame, column: str, query: list[float], k: int, budget: int, tenant: tuple[str, object] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Context, citations and warnings of one question: vector and keyword search within the tenant, fused, re-ranked, cut to the budget.

    vectors has the documents' key and, with a tenant, its column. Only the k best of either search are joined to texts.
    """
    if tenant is not None:
        docs = docs.filter(F.col(tenant[0]) == F.lit(tenant[1]))
    near = ranked(vector_top(vectors, key, column, query, k, tenant=tenant), key, k)
    hits = fuse(near, ranked(bm25(docs, key, text, words, k), key, k), key, k)
    hits = docs.select(key, text).join(F.broadcast(hits), key)
    best, warnings = rerank_or_keep(hits, rerank(hits, key, "score", text, k).join(hits.select(key, text), key))
    order = [F.desc("score"), F.asc(key)]
    kept = within_budget(best, order, text, budget)
    if kept.count() < best.count():
        warnings = [*warnings, "truncated"]
    return assemble(best, order, text, budget), citations(kept, order, key, text), warnings


def ranked(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The best k with rank from 1. hits holds at most k rows, so the single window is small."""
    best = hits.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(left: DataFrame, right: DataFrame, key: str, k: int, constant: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    a, b = (d.select(key, F.col("rank").alias(n)) for d, n in ((left, "_ra"), (right, "_rb")))
    part = lambda r, w: F.coalesce(F.lit(w) / (constant + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, (part("_ra", weights[0]) + part("_rb", weights[1])).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rerank(hits: DataFrame, key: str, score: str, text: str, k: int, alpha: float = 0.7) -> DataFrame:
    """alpha * score + (1 - alpha) * length in bytes, scaled to 0 to 1 over the hits."""
    alpha = min(max(alpha, 0.0), 1.0)
    size = F.octet_length(text)
    span = hits.agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    both = hits.join(F.broadcast(span))
    scaled = (size - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1))
    return both.select(key, (F.lit(alpha) * F.col(score) + F.lit(1 - alpha) * scaled).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rerank_or_keep(hits: DataFrame, reranked: DataFrame) -> tuple[DataFrame, list[str]]:
    """What the re-ranker gives, or the hits as they are, with a warning, if it gives nothing."""
    return (hits, ["re-ranking gave nothing"]) if reranked.isEmpty() else (reranked, [])


def within_budget(hits: DataFrame, order: list[Column], text: str, budget: int, group: list[str] = ()) -> DataFrame:
    """Hits, numbered from 1, as long as their entries stay within 4 * budget characters; the first that doesn't ends it.

    hits is a list cut to a few; many lists are told apart by group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = hits.withColumn("ordinal", F.row_number().over(w))
    entry = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] "), F.col(text), F.lit("\n\n"))
    sized = numbered.withColumn("entry", entry).withColumn("used", F.sum(F.length("entry")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.filter(F.col("used") <= 4 * budget)


def assemble(hits: DataFrame, order: list[Column], text: str, budget: int) -> DataFrame:
    """One row: the context."""
    kept = within_budget(hits, order, text, budget)
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "entry")))
    return kept.agg(F.array_join(F.transform(pairs, lambda x: x["entry"]), "").alias("context"))


def citations(hits: DataFrame, order: list[Column], key: str, text: str) -> DataFrame:
    ordinal = F.row_number().over(Window.orderBy(*order))
    return hits.select(key, ordinal.alias("offset"), F.octet_length(text).alias("length"), "score", F.col(text).alias("text"))


def estimated_tokens(text: Column, rate: float = 0.25) -> Column:
    return F.floor(F.length(text) * rate)


def last_messages(rows: DataFrame, conversation: str, turn: str, n: int) -> DataFrame:
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def truncate(rows: DataFrame, conversation: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """Messages that fit a token budget: the oldest go first, but neither system messages while there are others, nor the last other message.

    A conversation of system messages alone loses its oldest ones.
    """
    w = Window.partitionBy(conversation)
    sized = rows.withColumn("_size", estimated_tokens(F.col(text))).withColumn("_system", (F.col(role) == "system").cast("int"))
    sized = sized.withColumns({"_others": F.sum(1 - F.col("_system")).over(w), "_fixed": F.sum(F.col("_size") * F.col("_system")).over(w)})
    kind = Window.partitionBy(conversation, "_system").orderBy(F.desc(turn))
    sized = sized.withColumns({"_nth": F.row_number().over(kind), "_used": F.sum("_size").over(kind.rowsBetween(Window.unboundedPreceding, 0))})
    other = (F.col("_nth") == 1) | (F.col("_fixed") + F.col("_used") <= budget)
    alone = (F.col("_nth") == 1) | (F.col("_used") <= budget)
    keep = F.when(F.col("_system") == 0, other).otherwise((F.col("_others") > 0) | alone)
    return sized.filter(keep).select(*rows.columns)


def remembered(memories: DataFrame, importance: str, created: str, now: Column, decay: float, threshold: float) -> DataFrame:
    """Memories whose importance, decayed by their age in days, is still at the threshold; what is stored doesn't change."""
    days = (F.unix_micros(now) - F.unix_micros(F.col(created).cast("timestamp"))) / 86_400_000_000
    return memories.filter(F.col(importance) * F.exp(-decay * days) >= threshold)


def pseudo_embedding(text: Column, size: int) -> Column:
    """Bytes over 255 of the text's first size bytes, then zeros: for tests."""
    raw = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.conv(F.nullif(F.substring(raw, i * 2 + 1, F.lit(2)), F.lit("")), 16, 10).cast("double") / 255, F.lit(0.0)))


def batches(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with batch: rows in order, n at a time, from 0. order: a numeric column without ties.

    Ranges of it are numbered by themselves and what earlier ranges hold is added, so no task sorts the table.
    """
    bounds = df.approxQuantile(order, [k / 64 for k in range(1, 64)], 0.005)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    parts = df.withColumn("_part", part)
    ahead = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_ahead")
    return parts.join(F.broadcast(ahead), "_part").withColumn("batch", F.floor(nth / n).cast("long")).select(*df.columns, "batch")


def recall(found: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    hit = relevant.select(key).distinct().join(found.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.coalesce(F.try_divide(F.count("_hit"), F.count(F.lit(1))), F.lit(0.0)).alias("recall"))


