"""The quality classifier, quality rules, nearest neighbours, line dedup and the pipeline."""

import glob
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, line_dedup, neighbours, quality_classifier, quality_rules
from quern.llm.common import cut

FOLDER = "/root/testdata/sf0.01"


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, r in got.items() if r.predicted}


def plain_classifier(rows, texts):
    """FTRL-proximal with dictionaries, a weight at a time, over (doc_id, label) outside of the held-out fold."""
    import math
    import zlib

    part = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

    def features(text):
        words = [("0" if p.isdigit() else p) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for p in part.findall(w)]
        one = [zlib.crc32(w.encode()) for w in words]
        two = [0x5EED if a == b else (a * 0x9E3779B1 ^ (b * 0x85EBCA6B + 1)) % 2**32 for a, b in zip(one, one[1:], strict=False)]
        counts = {}
        for h in [*(a * 0xC2B2AE35 % 2**32 for a in one), *(b * 0x27D4EB2F % 2**32 for b in two)]:
            counts[h >> 14] = counts.get(h >> 14, 0) + 1
        length = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        return {k: math.log1p(c) / length for k, c in counts.items()}

    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= 0.005 else (math.copysign(0.005, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / 2 + 0.01)
    made = [({**features(texts[k]), None: 1.0}, y) for k, y in sorted(rows, key=lambda r: (zlib.crc32(f"order {r[0]}".encode()), str(r[0])))]
    for _ in range(3):
        for x, y in made:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g, was = (p - y) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / 2 * w[k]
                n[k] = was + g * g
    return lambda text: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in {**features(text), None: 1.0}.items())))


def test_classifier_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 300")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("doc_id < 300")
    rows = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    plain = plain_classifier(rows, texts)
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert len(rows) > 60 and max(abs(got[k] - plain(t)) for k, t in texts.items()) < 1e-4
    fewer = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels, sample=20).collect()}
    assert fewer != got


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (None, "text", "x"), (2, "again", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 7)], "doc_id long, quality int")
    assert [r.score for r in quality_classifier.classify(docs, none).collect()] == [0.5] * 4
    assert quality_classifier.accepted(docs, none).columns == docs.columns and quality_classifier.accepted(docs, none).count() == 4
    long = spark.createDataFrame([(5, "many words " * 40_000)], "doc_id long, text string")
    assert quality_classifier.classify(long, none).first().predicted == 1
    assert quality_classifier.classify(docs.limit(0), none).count() == 0 and quality_classifier.accepted(docs.limit(0), none).count() == 0


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, inside = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            inside.update(p + j for p in places for j in range(8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_quality_rules(spark):
    texts = ["", None, " \n ", "a b c d e f g h " * 4, "one\ntwo\none\n\n\n one", "é\u00a0x ### <b>", "\u65e5\u672c\u8a9e " * 30, "word" * 9000, "x\x0by\x0cz \x1c q", " ".join(map(str, range(40))), "\u0000" * 30]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150).collect()]
    docs = spark.createDataFrame([(k, t, None, True) for k, t in enumerate(texts)], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t), t
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(docs.drop("lang").limit(0)).count() == 0


def plain_measures(text):
    """Characters per token of both vocabularies, byte-fallback share and entropy, of words encoded one by one."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=quality_rules.default_path())
    other = tokenizers.Tokenizer.from_file(quality_rules.byte_path().replace(".tiktoken", ".json"))
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in library.encode(w)]
    n = sum(len(other.encode(w, add_special_tokens=False).ids) for w in words)
    shares = [ids.count(i) / len(ids) for i in set(ids)]
    entropy = -sum(p * np.log2(p) for p in shares) / np.log2(min(len(ids), 1024)) if len(ids) > 1 else 1.0
    chars = sum(map(len, words))
    return (chars / len(ids), chars / n, sum(map(library.is_byte, ids)) / len(ids), entropy) if ids else (0.0, 0.0, 0.0, 1.0)


def test_fertility_decides(spark):
    """kept by brute force, and each measure rejects what it is for."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 250").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, quality_rules.SHIPPED).collect()}
    rejected = 0
    for r in docs.collect():
        want = plain_measures(r.text)
        assert np.allclose((got[r.doc_id].chars_per_token, got[r.doc_id].chars_per_byte_token, got[r.doc_id].fallback_share, got[r.doc_id].token_entropy), want)
        band = quality_rules.SHIPPED[r.lang]
        fits = band.least <= want[0] <= band.most and band.byte_least <= want[1] <= band.byte_most and want[2] <= band.fallback and want[3] >= band.entropy
        assert got[r.doc_id].kept == (fits and not plain_rules(r.text)[5])
        rejected += not fits and not got[r.doc_id].base_failed
    assert 250 * 0.02 < rejected < 250 * 0.2
    rng = np.random.default_rng(6)
    prose = next(r.text for r in docs.collect() if r.lang == "en" and got[r.doc_id].kept and got[r.doc_id].n_words > 300)
    french = next(r.text for r in docs.collect() if r.lang == "fr" and got[r.doc_id].kept and got[r.doc_id].n_words > 300)
    noise = " ".join("".join(rng.choice(list("qxzjkvwbpf"), 7)) for _ in range(300))
    soup = " ".join(w + "".join(map(chr, rng.integers(0x10A0, 0x10F0, 2))) for w in prose.split()[:200])
    dull = " ".join(rng.choice(prose.split()[:9], 400))
    moji = " ".join(w.replace("e", "\u00c3\u00a9") for w in prose.split())
    kinds = {"prose": prose, "french": french, "noise": noise, "soup": soup, "dull": dull, "moji": moji}
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame([(k, t, "en") for k, t in kinds.items()], "doc_id string, text string, lang string"), quality_rules.SHIPPED).collect()}
    band = quality_rules.SHIPPED["en"]
    assert {k for k, r in out.items() if r.kept} == {"prose"} and not any(r.base_failed for r in out.values())
    assert out["noise"].chars_per_token < band.least and out["soup"].fallback_share > band.fallback and out["dull"].token_entropy < band.entropy
    assert out["french"].chars_per_byte_token < band.byte_least and out["moji"].chars_per_token < band.least


def test_shipped_bands_are_measured(spark):
    folder = FOLDER.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    measured = quality_rules.quality_rules(good).filter("NOT base_failed").join(docs.select("doc_id", "lang"), "doc_id")
    for lang, band in quality_rules.bands_of(measured).items():
        shipped = quality_rules.SHIPPED[lang]
        for name in ("least", "most", "byte_least", "byte_most", "fallback", "entropy"):
            assert abs(getattr(band, name) - getattr(shipped, name)) < 0.02, (lang, name)


def test_quality_rules_rows(spark):
    long = "word number %d " * 30_000 % tuple(range(30_000))
    docs = spark.createDataFrame([(None, long, None), (7, "x y", "en"), (7, "x y", "en")], "doc_id long, text string, lang string")
    got = quality_rules.quality_rules(docs).collect()
    assert sorted(((r.doc_id or 0, r.n_words, r.base_failed) for r in got)) == [(0, 90_000, False), (7, 2, True), (7, 2, True)]


def test_script_counts_whole_text():
    assert quality_rules.script("\u0434a" * 400 + "aa") == "LATIN"  # every second letter is Cyrillic
    assert quality_rules.script("1" * 500 + "\u0434" + "1" * 500) == "CYRILLIC" and quality_rules.script("12 ") == ""


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    x[5] = x[40]
    rows = [(k, v.tolist(), "r") for k, v in enumerate(x)] + [(2000, None, "r"), (2020, [0.0] * 32, "r"), (2040, [float("nan")] * 32, "r"), (2060, [1.0] * 31 + [None], "r"), (2080, [1.0], "r"), (None, [1.0] * 32, "r"), (2100, [], "r")]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, hit = x.astype(float), 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in sorted(found)] == sorted((-s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(np.argsort(-scores)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = neighbours.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, rank string")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("radius", [3, 9, 14])
def test_index_finds_all_within_radius(radius):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 40))
    codes = neighbours.Codes(x)
    index = neighbours.Index(codes, np.arange(500), x)
    signs = codes.signs(x)
    packed = np.packbits(signs, axis=1)
    for q in range(0, 500, 25):
        values = [int(index.value(signs[q : q + 1], p)[0]) for p in index.parts]
        assert index.within(values, packed[q], radius).tolist() == np.flatnonzero((signs != signs[q]).sum(axis=1) <= radius).tolist()


def recall(found, x, k=20):
    """found: neighbours by query; x: all vectors, by id."""
    hit = 0
    for q, near in found.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(near & set(np.argsort(-scores)[:k].tolist()))
    return hit / k / len(found)


def shares(x, k=20):
    """What part of the rows queries probe, and what part is within their radius."""
    codes = neighbours.Codes(x[:: max(1, len(x) // neighbours.SAMPLE)])
    index = neighbours.Index(codes, np.arange(len(x)), x)
    found = {q: set(i.tolist()) for q, i, _ in index.search(np.arange(0, len(x), 20), x[::20], codes.radius(x[: neighbours.SAMPLE], k, len(x)), k, k)}
    met, probed, within = index.tally
    return recall(found, x, k), probed / met, within / met


def test_recall_on_shipped_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], float)
    found = {}
    for r in neighbours.search(vectors).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    got, (_, probed, within) = recall(found, x), shares(x)
    print("neighbours: recall, probed, within", got, probed, within)
    assert got >= 0.9 and set(found) == set(range(0, len(x), 20)) and within < 0.35


def test_index_selects_where_vectors_have_structure():
    """Vectors around many centres: the index meets a small share of the rows, and it falls as rows grow."""
    rng, last = np.random.default_rng(5), 1.0
    centres = rng.normal(size=(400, 64))
    for n in (2000, 16_000):
        x = centres[np.arange(n) % 400] + 0.25 * rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got, probed, _ = shares(x, min(20, n // 400 - 1))
        print("clusters: rows, recall, probed", n, got, probed)
        assert got >= 0.9 and probed < last
        last = probed
    assert last < 0.1


def test_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(37, 24))
    rows = [(k, x[k % 37].tolist()) for k in rng.permutation(400).tolist()] + [(41, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {}
    for r in neighbours.search(df, k=30).collect():
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    again = neighbours.search(df.repartition(5), k=30)
    assert {tuple(r) for r in again.collect()} == {(q, k, i, -s) for q, near in by.items() for k, s, i in near}
    for q, near in by.items():
        near.sort()
        assert [(s, i) for _, s, i in near] == sorted((s, i) for _, s, i in near)
        same = [i for _, s, i in near if i % 37 == q % 37 and not (i == 41 and rows[-1][1] != x[i % 37].tolist())]
        assert all(s == near[0][1] for _, s, i in near if i in same and i % 37 == near[0][2] % 37)
    assert sum(i == 41 for near in by.values() for _, _, i in near) > 0
    mixed = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0]), (1, [2.0, 2.0]), (2, [3.0]), (3, [1.0] * 3)], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in neighbours.search(mixed).collect()) == [(0, 1, 6.0), (20, 2, 3.0)]
    with pytest.raises(ValueError):
        neighbours.search(spark.createDataFrame([(k, [1.0] * (k + 1)) for k in range(20)], "vec_id long, embedding array<double>"))


def test_line_dedup(spark):
    unique = lambda k: " ".join(f"w{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k + j * j) % 26)}x" for j in range(9))
    line, passage = "this page was printed on 2024-01-02 at noon", "a shared passage of many plain words that several pages hold in common"
    rows = [(k, f"{unique(k)}\n{line.replace('02', f'{k:02d}')}\n{unique(k + 50)}\n") for k in range(6)]
    rows += [(k, f"{passage if k % 2 else passage.replace('plain', 'simple')}\n{unique(k)}") for k in range(10, 15)]
    rows += [(k, f"{unique(200)}\n{unique(201)}\n{unique(202)}") for k in range(20, 40)]  # copies of a document
    rows += [(50, "of the\nand so"), (51, "of the\nand so"), (52, "of the\nso"), (53, ""), (54, None), (None, None), (53, "")]
    docs = spark.createDataFrame([(k, t, len(t or ""), "c") for k, t in rows], "doc_id long, text string, n_chars long, _line string")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines", "_dropped"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    before = dict(rows)
    assert by[0][0].text == before[0] and by[10][0].text == before[10]  # the first one keeps its line
    for k in range(1, 6):
        assert by[k][0].text == f"{unique(k)}\n{unique(k + 50)}\n" and by[k][0]._dropped == 1 and by[k][0].n_chars == len(by[k][0].text)
    assert all(by[k][0].text == unique(k) for k in range(11, 15))
    assert all(by[k][0].text == before[k] for k in [*range(20, 40), 50, 51, 52, 53, 54]) and len(by[53]) == 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def words_of(k, n=9):
    """A line that shares no template with that of another k."""
    return " ".join(f"q{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + j)}" for j in range(n))


def deduplicated_lines(spark, texts):
    """By place in texts: what is left of them."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}


def test_line_dedup_short_lines(spark):
    texts = [f"{words_of(k)}\nAll rights reserved.\n{words_of(k, 2)}\n{words_of(k, 3)}" for k in range(5)]
    texts += [f"{words_of(k)}\n\nPage {k} of 9\n{words_of(k, 4)}\n{k}" for k in range(5, 10)]
    texts += [f"{words_of(k)}\nMore" for k in range(10, 12)]
    got = deduplicated_lines(spark, texts)
    assert got[0] == texts[0] and got[5] == texts[5]
    assert all(got[k] == f"{words_of(k)}\n{words_of(k, 2)}\n{words_of(k, 3)}" for k in range(1, 5))
    assert all(got[k] == f"{words_of(k)}\n\n{words_of(k, 4)}\n{k}" for k in range(6, 10))  # numbers alone are no template
    assert all(got[k] == texts[k] for k in (10, 11))  # in two documents only


def plain_line_dedup(rows):
    """The tree over all documents, line by line: what is left of each text."""
    split = [[x.split() for x in (t or "").encode().split(b"\n")] for _, t in rows]
    mask = lambda w: tuple(b"<*>" if re.search(rb"\d", x) else x for x in w)
    kind = [tuple(sorted(b" ".join(w) for w in found if w)) for found in split]

    def short(w):
        return tuple(w) if set(mask(w)) == {b"<*>"} else mask(w)

    leaves, holders = {}, {}
    for c, found in zip(kind, split, strict=True):
        for w in found:
            if len(w) >= 6:
                leaves.setdefault((len(w), mask(w)[:3]), set()).add(c)
                holders.setdefault(mask(w), set()).add(c)
    long = [m for m in holders if len(leaves[len(m), m[:3]]) >= 3]
    counts = {}
    for m in long:
        for k, token in enumerate(m):
            counts[len(m), m[:3], k, token] = counts.get((len(m), m[:3], k, token), 0) + len(holders[m])
    general = {}
    for m in long:
        rare = [k for k, token in enumerate(m) if token != b"<*>" and counts[len(m), m[:3], k, token] < 3]
        general[m] = tuple(b"<*>" if k in rare else x for k, x in enumerate(m)) if 5 * len(rare) <= len(m) else m
    root = {g: g for g in general.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for m, g in general.items():
        for k in range(3, len(g)):
            root[find(g)] = find(by.setdefault((m[:3], k, g[:k], g[k + 1 :]), g))
    name = lambda w: find(general[mask(w)]) if len(w) >= 6 and mask(w) in general else short(w) if len(w) < 6 else mask(w)
    seen = {}
    for (k, _), c, found in zip(rows, kind, split, strict=True):
        for w in filter(None, found):
            held = seen.setdefault(name(w), {})
            held[c] = min(held.get(c, (True, 0)), (k is None, k or 0))
    first = {t: min((at, c) for c, at in held.items())[0] for t, held in seen.items() if len(held) >= 3}
    left = []
    for (_, t), c, found in zip(rows, kind, split, strict=True):
        texts = (t or "").split("\n")
        left.append("\n".join(x for x, w in zip(texts, found, strict=True) if not w or name(w) not in first or seen[name(w)][c] == first[name(w)]))
    return left


def test_line_dedup_is_the_plain_tree(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text or "" for r in line_dedup.dedup_lines(docs).collect()}
    want = dict(zip((k for k, _ in rows), plain_line_dedup(rows), strict=True))
    assert got == want and sum(got[k] != (t or "") for k, t in rows) > 20


def test_line_dedup_fields(spark):
    lines = [f"order placed by {words_of(k, 1)} on our site today" for k in range(40)] + [f"order placed by us {words_of(k, 1)} {words_of(k + 9, 3)}" for k in range(40)]
    lines += [f"dear friend of {('Ann', 'Bob', 'Cid')[k % 3]} your parcel left {('Rome', 'Bonn', 'Oslo', 'Kiel')[k % 4]} on that same day" for k in range(12)]
    texts = [f"{line}\n{words_of(k)}\n{words_of(k, 7)}" for k, line in enumerate(lines)]
    got = deduplicated_lines(spark, texts)
    assert all(got[k] == f"{words_of(k)}\n{words_of(k, 7)}" for k in (*range(1, 40), *range(81, 92)))
    assert got[0] == texts[0] and got[80] == texts[80] and got[50] == texts[50]
    assert list(got.values()) == plain_line_dedup(list(enumerate(texts)))


def test_line_dedup_clashes_and_long_texts(spark):
    line, long = "a shared line of many plain words here", " ".join(f"v{k}x y{k % 89}" for k in range(30_000))
    names = "doc_id long, text string, _doc long, _drop string, _lines int, _dropped int, _class string, `a.b` int, _line long, n_chars int"
    rows = [(k, f"{line}\n{words_of(k)}", 7, "d", 1, 1, "c", 3, 9, 1) for k in range(4)] + [(9, f"{long}\n{line}", 7, "d", 1, 1, "c", 3, 9, 1), (9, None, 7, "d", 1, 1, "c", 3, 9, 1)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, names))
    assert got.columns == ["doc_id", "text", "_doc", "_drop", "_class", "a.b", "_line", "n_chars", "_lines", "_dropped"]
    found = {(r.doc_id, r.text): r for r in got.collect()}
    assert set(found) == {(0, rows[0][1]), *((k, words_of(k)) for k in range(1, 4)), (9, long), (9, None)}
    assert all((r._doc, r._drop, r._class, r["a.b"], r._line) == (7, "d", "c", 3, 9) for r in found.values())
    assert found[9, long]._dropped == 1 and found[9, long]._lines == 2 and found[9, long].n_chars == len(long)


def test_line_dedup_beside_copies(spark):
    line = "a shared passage of many plain words that pages hold"
    page = lambda k: f"{words_of(k)}\n{line}\n{words_of(k, 7)}"
    left = lambda k: f"{words_of(k)}\n{words_of(k, 7)}"
    got = deduplicated_lines(spark, [*map(page, range(10)), *[page(100)] * 40])
    assert got[0] == page(0) and all(got[k] == left(k) for k in range(1, 10)) and all(got[k] == left(100) for k in range(10, 50))
    got = deduplicated_lines(spark, [*[page(100)] * 40, *map(page, range(10))])
    assert all(got[k] == page(100) for k in range(40)) and all(got[k + 40] == left(k) for k in range(10))


def test_line_dedup_documents_of_one_line(spark):
    code = [f"Your verification code is {k * 7919 + 100000} do not share it" for k in range(8)]
    texts = [*code, *[f"{c}\nRequest number {k} of today was seen" for k, c in enumerate(code)]]
    passage = "\n".join(words_of(k) for k in range(4))
    texts += [f"{words_of(k, 2)}\n{passage}" for k in range(50, 62)]
    got = deduplicated_lines(spark, [*texts, *["one line that many copies have alone"] * 5])
    assert got[0] == texts[0] and all(got[k] == "" for k in range(1, 8))
    assert got[8] == "Request number 0 of today was seen" and all(got[k] == "" for k in range(9, 16))
    assert got[16] == texts[16] and all(got[k] == words_of(k + 34, 2) for k in range(17, 28))
    assert all(got[k] == "one line that many copies have alone" for k in range(28, 33))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.filter("doc_id < 150")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, some, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
            rows = out.collect()
            assert rows
            some = spark.createDataFrame(rows, docs.schema)
            assert stage(spark, docs.limit(0), FOLDER).count() == 0
    by = {}
    for r in out.collect():
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 2048 and sum(by.values()) / 2048 / len(by) > 0.9


def test_pipeline_run(spark, tmp_path):
    """run() gives what its stages give one after the other, on rows with nulls, repeats, long texts and more columns, and leaves no folder."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 120").withColumns({"_doc": F.lit(1), "kept": F.lit("x"), "_before": F.lit(2.0)})
    long = docs.filter("doc_id = 3").withColumns({"doc_id": F.lit(500).cast("long"), "text": F.repeat("text", 60)})
    odd = docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs.unionByName(docs.limit(4)).unionByName(long).unionByName(odd).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    left, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), common.shared_folder(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, cut(stage(spark, left, str(tmp_path)))
        if name != "best-fit packing":
            assert left.columns == before.columns and left.count() > 0
    rows = lambda df: sorted(map(tuple, df.drop("sequence_id", "offset").collect()), key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert rows(got) == rows(left) and got.columns == left.columns
    assert not glob.glob(f"{folder.removeprefix('file:')}/pipeline-*")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_alone_sends_few_rows(spark, name):
    """A stage called without run() sends ARROW_ROWS whole texts to Python at once, not a whole partition; a number that the session has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def most(chosen: str | None) -> int:
        own = spark.newSession()
        if chosen:
            own.conf.set(key, chosen)
        dict(corpus_pipeline.STAGES)[name](own, own.read.parquet(f"{FOLDER}/documents.parquet").limit(0), FOLDER)
        sizes = own.range(0, 2500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        return max(r.n for r in sizes.collect())

    assert most(None) == common.ARROW_ROWS
    assert most("2000") == 2000
