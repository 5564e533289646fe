"""Quality rules: word and line repetition, and a tokeniser's fertility held against bands for each language or script."""

from __future__ import annotations

import array
import base64
import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, keep, take_over

SLICE = 512
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8
#: The entropy of a text's tokens stops growing with its length at about so many tokens.
PLATEAU = 1024
#: Words whose tokens a worker keeps.
MEMO = 300_000
#: Texts whose words are encoded at once.
TOGETHER = 64


@dataclass(frozen=True)
class Band:
    """Texts outside are rejected.

    least, most: characters per token of the vocabulary with byte fallback; byte_least, byte_most: of the one of bytes;
    fallback: largest share of byte-fallback tokens; entropy: smallest entropy of tokens, in bits over log2 of their
    number or of PLATEAU.
    """

    least: float
    most: float
    byte_least: float
    byte_most: float
    fallback: float
    entropy: float


#: By language, else by script, else by "": wide bands for any natural prose.
BANDS = {
    "en": Band(1.6, 7.0, 1.6, 7.0, 0.02, 0.5),
    "de": Band(1.6, 7.0, 1.4, 7.0, 0.02, 0.5),
    "fr": Band(1.5, 7.0, 1.4, 7.0, 0.02, 0.5),
    "es": Band(1.5, 7.0, 1.4, 7.0, 0.02, 0.5),
    "LATIN": Band(1.2, 7.5, 1.0, 7.5, 0.05, 0.45),
    "CYRILLIC": Band(1.0, 7.0, 0.3, 7.0, 0.05, 0.5),
    "GREEK": Band(0.6, 7.0, 0.3, 7.0, 0.2, 0.5),
    "CJK": Band(0.3, 4.0, 0.2, 4.0, 0.7, 0.4),
    "": Band(0.2, 8.0, 0.2, 8.0, 0.9, 0.4),
}
#: Narrow bands for the languages of the shipped tables, whose prose is invented: what bands_of() gives for the documents of
#: sf0.1 that pass the base rules and are labelled good, rounded outwards.
SHIPPED = BANDS | {
    "en": Band(1.99, 2.54, 2.18, 2.66, 0.02, 0.66),
    "de": Band(2.06, 2.56, 2.03, 2.41, 0.02, 0.64),
    "fr": Band(1.71, 2.31, 1.82, 2.30, 0.02, 0.64),
    "es": Band(1.76, 2.19, 1.85, 2.24, 0.02, 0.64),
}
#: bands_of() leaves out these shares below and above, and adds ROOM to what is above.
LOW, HIGH, ROOM = 0.0025, 0.999, 0.05


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pieces:
    """The tokens of words by public vocabularies: ids by the one with byte fallback, their number by the one of bytes.

    Each distinct word is encoded once, many at a time; at most MEMO words are kept.
    """

    def __init__(self, path: str, ranks: str):
        import sentencepiece
        import tiktoken

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.library.is_byte(k) for k in range(self.library.get_piece_size())])
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.other = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.ids: dict[bytes, bytes] = {}
        self.number: dict[bytes, int] = {}
        keep("rules", self.ids.clear)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > MEMO:
            self.ids.clear()
            self.number.clear()
            new = list(words)
        if new:
            texts = [w.decode("utf-8", "replace") for w in new]
            self.ids.update(zip(new, (array.array("I", ids).tobytes() for ids in self.library.encode(texts, num_threads=1)), strict=True))
            self.number.update(zip(new, map(len, map(self.other.encode_ordinary, texts)), strict=True))


@functools.cache
def pieces(path: str, ranks: str) -> Pieces:
    return Pieces(path, ranks)


@functools.cache
def word_hashes() -> Memo:
    return Memo("rules", xxhash.xxh3_64_intdigest)


def script(text: str) -> str:
    """The script of most letters of the text; each different letter is looked up once."""
    seen = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            seen[unicodedata.name(c, "").partition(" ")[0]] += n
    if not seen:
        return ""
    first = seen.most_common(1)[0][0]
    return "CJK" if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else first


def repeated(words: list[bytes]) -> int:
    """The words inside of WINDOW-word windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    of = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    h = of[:n].copy()
    for k in range(1, WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of[k : n + k]
    _, at, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    starts = np.flatnonzero(counts[at] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: str, words: list[bytes], paths: tuple[str, str]) -> tuple[float, float, float, float]:
    """What the bands hold: characters per token of either vocabulary, share of byte-fallback tokens, scaled entropy of tokens."""
    of = pieces(*paths)
    if not all(map(of.ids.__contains__, words)):
        of.learn(set(words))
    ids = np.frombuffer(b"".join(map(of.ids.__getitem__, words)), "<u4")
    if not len(ids):
        return 0.0, 0.0, 0.0, 1.0
    counts = np.unique(ids, return_counts=True)[1]
    entropy = math.log2(len(ids)) - float(counts @ np.log2(counts)) / len(ids)
    scaled = entropy / math.log2(min(len(ids), PLATEAU)) if len(ids) > 1 else 1.0
    return chars(text) / len(ids), chars(text) / max(1, sum(map(of.number.__getitem__, words))), float(of.fallback[ids].mean()), scaled


def chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def within(band: Band, per_token: float, per_byte_token: float, fallback: float, entropy: float) -> bool:
    return band.least <= per_token <= band.most and band.byte_least <= per_byte_token <= band.byte_most and fallback <= band.fallback and entropy >= band.entropy


def judge(text: str | None, lang: str | None, bands: dict[str, Band], paths: tuple[str, str]) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    again = repeated(words)
    failed = len(words) < 20 or 100 * again > 30 * len(words)
    measured = measures(text, words, paths)
    band = bands.get(lang or "") if lang else None
    if band is None:
        band = bands.get(script(text)) or bands[""]
    return len(words), chars(text), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, not failed and within(band, *measured), *measured


def bands_of(measured: DataFrame, low: float = LOW, high: float = HIGH, room: float = ROOM) -> dict[str, Band]:
    """Bands by lang from what quality_rules() measured of documents known to be good (its columns and lang).

    Characters per token and entropy may go down to the share low of the documents; characters per token and the
    byte-fallback share up to the share high, and room more, the latter to 0.02 at least.
    """
    names = ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")
    found = measured.groupBy("lang").agg(*(F.percentile_approx(n, [low, high], 10_000).alias(n) for n in names))
    up = 1 + room
    return {r["lang"]: Band(r[names[0]][0], r[names[0]][1] * up, r[names[1]][0], r[names[1]][1] * up, max(0.02, r[names[2]][1] * up), r[names[3]][0]) for r in found.collect()}


def quality_rules(docs: DataFrame, bands: dict[str, Band] | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_per_token, chars_per_byte_token, fallback_share, token_entropy.

    One scan, no shuffle. A text is kept if the base rules pass and its measures lie in the band of its language (column
    lang, if the table has one), else of its script, else of "". paths: a vocabulary with byte fallback, as sentencepiece
    reads it, and one of bytes, as ranks for tiktoken. Every word is encoded on its own, as tokens never cross white space.
    bands: BANDS by default, which only reject what no prose of a language looks like; bands_of() measures narrower ones.

    Null and empty texts have no words and fail the base rules. Texts of any length are taken whole. Rows are judged each
    by itself, whatever their doc_id, null ones and repeated ones too. Other columns than doc_id, text and lang are not read,
    whatever their names. An empty table gives none.
    """
    bands, paths = bands or BANDS, paths or (default_path(), byte_path())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()] * 4
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    arrow = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
    columns = ["doc_id", "text", *(["lang"] if "lang" in docs.columns else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("rules")
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                langs = batch.column(2).to_pylist() if len(columns) == 3 else [None] * batch.num_rows
                texts, rows = batch.column(1).to_pylist(), []
                for first in range(0, len(texts), TOGETHER):
                    some = texts[first : first + TOGETHER]
                    pieces(*paths).learn({w for t in some if t for w in t.encode("utf-8", "surrogatepass").split()})
                    with np.errstate(over="ignore"):
                        rows += [judge(t, x, bands, paths) for t, x in zip(some, langs[first : first + TOGETHER], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True))], names=schema.names)

    return docs.select(*columns).mapInArrow(each, schema)
