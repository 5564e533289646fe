import random
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.token_counts import token_counts
from quern.llm.vocabulary import Counter, Encoder, default_path

PATH = default_path()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER, ENCODER = Counter(PATH), Encoder(PATH)
HARD = ["", " ", "don't we'll I'M 'S", "Straße ΑΣ ΑΣΣ. İI", "a\x1cb\x85c d", "é ȩ́ ẛ̣", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "12 ½ ²3 Ⅷ", "日本語のテキスト 한국어", "🙂🙂👩‍👩‍👧 zwj", "a" * 3000, "\x00\x01 ​﻿", "###$$$%%%", "́ͅ x"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def agrees(text):
    assert COUNTER.count(text) == len(ids(text)), text
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(text), text


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    agrees(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    agrees(text)


def test_every_letter():
    for low in range(0, 0x30000, 0x400):
        text = " ".join(f"a{chr(c)}b{chr(c)}" for c in range(low, low + 0x400) if not 0xD800 <= c < 0xE000)
        if text:
            agrees(text)


@pytest.mark.parametrize("bounds", [{}, {"pretokens": 7}, {"pretokens": 20, "characters": 30}, {"characters": 1}])
def test_many_texts_at_once(bounds):
    texts = [*HARD, None, "\x85 a\xa0\x85b \x1f", "a\x7fb\x00 don't", " \n\t ", "é é. e\u0301 ﬁ", *HARD, "日本語 the", "the end", *(f"w{k}x the" for k in range(40))]
    encoder = Encoder(PATH, **bounds)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids(t or "") for t in texts]
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]


def test_words_are_encoded_in_bulk():
    """Calls of Python functions do not grow with the number of different words."""
    texts = [" ".join(f"{a}{b}{k % 7}{c}" for k in range(40)) for a in ("tion", "ä", "x") for b in ("ing", "é", "") for c in (".", "", "$$")]
    texts = [f"{t} {chr(97 + k % 26)}word{k}, çà{k}" for k, t in enumerate(texts * 40)]
    calls = []
    encoder = Encoder(PATH)
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert len({w for t in texts for w in t.split()}) > 2000
    assert len(calls) < 2 * len(texts) + 200


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_tokens string")


def test_token_counts(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, None), (3, "two rows"), (3, "two rows"), (9, "word " * 5000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, rows)).collect())
    assert got == sorted((k is None, k or 0, len((t or "").encode()), n := len(ids(t or "")), n > 2048) for k, t in rows)
    assert token_counts(frame(spark, [])).count() == 0


def check_packed(rows, texts, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= limit
    want = []
    for k, t in texts:
        whole = [*ids(t or ""), 0]
        for n, at in enumerate(range(0, len(whole), limit)):
            part = whole[at : at + limit]
            want.append((k if k is not None else -1, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return by


def test_pack(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "."]) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    texts += [(7, "same"), (7, "same"), (None, None), (1000, "long " * 500)]
    rows = packing.pack(frame(spark, texts), limit=64).collect()
    by = check_packed(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) * 1.05 + 1
    assert packing.pack(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=12))
def test_plan_is_best_fit(counts):
    limit = 40
    free: dict[int, int] = {}
    bins = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = min((r for r, n in free.items() if n and r >= length), default=None)
            if best is None:
                bins, best = bins + 1, limit
            else:
                free[best] -= 1
            free[best - length] = free.get(best - length, 0) + 1
    used = {}
    for length, low, high, first, each, at in packing.plan(counts, limit):
        for r in range(low, high):
            used.setdefault(first + (r - low) // each, []).append((at + (r - low) % each * length, length))
    assert len(used) == bins and sum(map(len, used.values())) == sum(counts.values())
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= limit
