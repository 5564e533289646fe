"""Secret scans with a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_checked

#: A Boolean query: one of the clauses must hold, a clause holds if all its trigrams occur. {frozenset()} always holds.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset({frozenset()})
#: Most strings that are followed at once, and most clauses of a query; beyond that a query is weakened, which only adds candidates.
STRINGS, CLAUSES = 64, 32
#: Candidates that are broadcast at most; with more, both sides are shuffled.
BROADCAST = 500_000
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; pattern: for Python's parser and Java alike; a match counts if its group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which equal starts are listed. The run patterns take only long runs, as shorter ones would be dropped.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Well-known shapes of keys that issuers publish.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CLAUSES:
        return min(a, b, key=lambda q: (q == ALWAYS, len(q)))
    joined = {x | y for x in a for y in b}
    return frozenset(x for x in joined if not any(y < x for y in joined))


def grams(strings: set[str]) -> Query:
    """That one of the strings occurs."""
    if len(strings) > CLAUSES or any(len(s) < 3 for s in strings):
        return ALWAYS
    found = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return frozenset(x for x in found if not any(y < x for y in found))


def letters(items) -> set[str] | None:
    """What a class can match, folded, if these are few ASCII characters."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    return {chr(c).lower() for c in found} if len(found) <= 8 and all(c < 128 for c in found) else None


def follow(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes can match, folded, if these are few; and a query that every match meets."""
    strings, need, whole = {""}, ALWAYS, True
    for kind, value in nodes:
        exact, query = None, ALWAYS
        if kind is op.LITERAL:
            exact = {chr(value).lower()} if value < 128 else None
        elif kind is op.IN:
            exact = letters(value)
        elif kind is op.AT:
            exact = {""}
        elif kind is op.SUBPATTERN:
            exact, query = follow(value[3])
        elif kind is op.BRANCH:
            ways = [follow(w) for w in value[1]]
            exact = set().union(*(w for w, _ in ways)) if all(w is not None for w, _ in ways) else None
            every = [grams(w) if w is not None else q for w, q in ways]
            query = ALWAYS if ALWAYS in every or sum(map(len, every)) > CLAUSES else frozenset().union(*every)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            one, query = follow(inner)
            if low == 0:
                exact, query = ({"", *one} if one is not None and high == 1 else None), ALWAYS
            elif one is not None and len(one) ** min(low, 8) <= STRINGS:
                times = {"".join(p) for p in itertools.product(one, repeat=min(low, 8))}
                exact, query = (times, query) if low == high <= 8 else (None, both(query, grams(times)))
        if exact is not None and len(exact) * len(strings) <= STRINGS:
            strings = {a + b for a in strings for b in exact}
            need = both(need, query)
        else:
            need, whole = both(both(need, grams(strings)), query), False
            strings = exact if exact is not None else {""}
    return (strings, need) if whole else (None, both(need, grams(strings)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of the pattern meets; letters are folded to lower case."""
    strings, need = follow(parser.parse(pattern))
    return need if strings is None else both(need, grams(strings))


def index(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """The inverted index of the vocabulary: postings gram, doc_id."""
    has = F.transform(F.array(F.lower(text)), lambda t: F.filter(F.array(*map(F.lit, vocabulary)), lambda g: F.contains(t, g)))[0]
    return docs.select("doc_id", F.explode(has).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersects the postings of each clause: doc_id, and the kinds of the rules whose query its postings meet."""
    rows = [(g, kind, k, len(clause)) for kind, query in queries.items() for k, clause in enumerate(sorted(query, key=sorted)) for g in sorted(clause)]
    clauses = postings.sparkSession.createDataFrame(rows, "gram string, kind string, clause int, need int")
    named = postings.join(F.broadcast(clauses), "gram").repartition("doc_id")
    met = named.groupBy("doc_id", "kind", "clause", "need").agg(F.countDistinct("gram").alias("n")).filter("n = need")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))


def running(steps: Column) -> Column:
    """The running sums of an array, each part from the sums of blocks, so that its cost stays near the array's length."""

    def sums(a: Column) -> Column:
        add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
        ahead = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))), lambda b: add(F.slice(a, F.lit(1), b * BLOCK)))
        within = lambda o: F.transform(a, lambda _, i: F.element_at(o, F.floor(i / BLOCK).cast("int") + 1) + add(F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))
        return F.transform(F.array(ahead), within)[0]

    return F.transform(F.array(steps), sums)[0]


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The leftmost non-overlapping matches: structs of start, rank of the kind, end, in code points. What is between matches tells where they are."""

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ends = F.zip_with(running(steps), s["found"], lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("kind"), e.alias("end")))
        if not rule.least:
            return ends
        kept = F.filter(F.zip_with(ends, s["group"], lambda e, g: F.struct(e.alias("span"), (F.length(g) >= rule.least).alias("long"))), lambda x: x["long"])
        return F.transform(kept, lambda x: x["span"])

    pattern = F.lit(rule.pattern)
    parts = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("group"))
    return F.transform(F.array(parts), placed)[0]


def joined(all_spans: Column, names: list[str]) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> of each base kind, base_sha256 and spans (kind:start:end by start, then by rule).

    Each rule's regex gives a Boolean trigram query. One scan builds the inverted index of the trigrams that occur in
    queries; the postings of each clause are intersected by counting, and a second scan verifies the candidates with
    the regex itself. A rule without a mandatory trigram, as hex runs, scans every text. Candidates are broadcast only
    if they are seen to be few; else both sides are shuffled by doc_id.

    Null texts count as empty. Rows with the same doc_id share their candidates, and each is verified on its own text;
    rows without a doc_id are verified by every rule. Starts and ends are code points. Texts of any length are scanned
    whole. Repeated rows give repeated results; equal starts are ties, listed in the order of the rules. Other columns are
    not read, whatever their names. An empty table gives none.
    """
    rules = [*base, *more]
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALWAYS}
    vocabulary = sorted({g for q in queries.values() for clause in q for g in clause})
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if vocabulary:
        found = cut(candidates(index(rows.filter("doc_id IS NOT NULL"), vocabulary, "_text"), queries))
        rows = join_checked(rows, found, "doc_id", "left", BROADCAST)
    else:
        rows = rows.withColumn("_kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    t = F.col("_text")

    def of(k: int, rule: Rule) -> Column:
        due = (F.array_contains("_kinds", rule.kind) | F.col("doc_id").isNull()) if rule.kind in queries else t.rlike(rule.pattern)
        return F.when(due, spans(t, rule, k)).otherwise(none)

    rows = rows.select("doc_id", *(of(k, r).alias(f"_s{k}") for k, r in enumerate(rules)))
    first = F.array_sort(F.concat(*(F.col(f"_s{k}") for k in range(len(base)))))
    every = F.array_sort(F.concat(*(F.col(f"_s{k}") for k in range(len(rules)))))
    names = [r.kind for r in rules]
    return rows.select("doc_id", *(F.size(f"_s{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(base)), F.sha2(joined(first, names), 256).alias("base_sha256"), joined(every, names).alias("spans"))
