import random

import numpy as np

from quern.llm import near_dup


def brute(texts, n, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {k: shingles(t) for k, t in texts}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = [(k, " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(40)]
    base = [word() for _ in range(120)]
    for k in range(100, 260):  # a group in which each is near some others only
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        texts.append((k, " ".join(copy)))
    passage = [word() for _ in range(40)]
    texts += [(k, " ".join([*passage, *(word() for _ in range(25))])) for k in range(300, 360)]
    texts += [(400, "Same Text here"), (401, "same text HERE"), (402, "same text"), (403, ""), (404, None), (405, "  \n"), (406, None)]
    return texts


def test_near_duplicates(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, kept int")
    for n in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, n).collect()}
        assert got == brute(texts, n)
    left = near_dup.deduplicated(docs, 5)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, (_, c) in brute(texts, 5).items() if k == c)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty, 4).count() == 0 and near_dup.deduplicated(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(docs, 4).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in near_dup.deduplicated(docs).collect()) == [0, 1]


def test_intersections_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 300))) for _ in range(90)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(90), np.arange(90)))
    a, b = a[a < b], b[a < b]
    assert len(a) > near_dup.SINGLY
    assert near_dup.intersections(sets, a, b).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)]
    edges = [(p, c) for p, cs in near_dup.forest(6, np.array([0, 1, 4]), np.array([1, 2, 5])) for c in cs]
    assert len(edges) == 3 and {frozenset(e) for e in edges} == {frozenset(e) for e in ((0, 1), (1, 2), (4, 5))}


def test_repeated_ids_text_ids_and_clashes(spark):
    long = " ".join(f"w{k * k % 977}" for k in range(30_000))
    rows = [(5, "one two three four five six"), (5, "quite another text that stands alone here"), (9, "one two three four five six"), (7, long), (8, long + " end"), (8, long + " end")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, kept string, n_shingles int")
    left = near_dup.deduplicated(docs).collect()
    assert sorted((r.doc_id, len(r.text), r.kept, r.n_shingles) for r in left) == sorted((k, len(t), "x", 3) for k, t in (rows[0], rows[1], rows[3]))
    texts = corpus()
    named = spark.createDataFrame([(f"d{k:05d}", t) for k, t in texts], "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(named, 4).collect()}
    assert got == {f"d{k:05d}": f"d{c:05d}" for k, (_, c) in brute(texts, 4).items()}
    assert {r.doc_id for r in near_dup.deduplicated(named, 5).collect()} == {f"d{k:05d}" for k, (_, c) in brute(texts, 5).items() if k == c}


def test_blocks_of_one_list(spark, monkeypatch):
    """Lists that are cut to many blocks, with stars in several copies, give the same groups."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "DEALT", 5)
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 4).collect()} == brute(texts, 4)


def test_components_take_few_rounds(spark):
    ids = list(range(4096))
    random.Random(8).shuffle(ids)
    links = [(min(p), max(p)) for p in zip(ids, ids[1:], strict=False)] + [(5001, 5002), (5000, 5002), (7, 7)]
    df = spark.createDataFrame(links, "_a long, _b long").repartition(3)
    for held in (2, near_dup.HELD):
        rounds = []
        got = {r._id: r._component for r in near_dup.components(df, held, rounds).collect()}
        assert got == {**dict.fromkeys(ids, 0), 5000: 5000, 5001: 5000, 5002: 5000}
        assert len(rounds) <= 16


def test_lost():
    assert near_dup.lost() < 2e-8 < near_dup.lost(33) and near_dup.lost(30) < 1e-9 and near_dup.lost(percent=85) < 1e-11
