"""The public word-end BPE vocabulary: its normaliser and pre-tokeniser, token counts by heap merging, token ids by the library."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from .common import Memo, keep

#: Unicode's White_Space: fixed values.
SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = regex.compile(f"[{SPACE}]+")
#: Ranges of letters and signs that regex and the library's pre-tokeniser are tested to class alike; texts with others go through the library's own.
ALIKE = ((0x0, 0x557), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F5FF))
UNSURE = regex.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if a else "\\x00-" + chr(b) for a, b in ALIKE) + "]")
#: What str.split() also takes for white space, but Unicode's property does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words:
    """Splits texts to chunks that the vocabulary encodes one by one: no merge crosses white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        rule = next(p["pattern"]["Regex"] for p in self.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretoken = regex.compile(rule.replace(r"[^\s", f"[^{SPACE}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in self.spec["added_tokens"]) or r"(?!)")
        self.letters = byte_letters()
        self.translated = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.end = self.spec["model"]["end_of_word_suffix"] or ""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)

    def has_special(self, text: str) -> bool:
        return "<|" in text and self.special.search(text) is not None

    def normal(self, text: str) -> str:
        """The text normalised (NFC, lower case letter by letter), with no other white space than ASCII's."""
        if not text.isascii():
            if UNSURE.search(text):
                return SPLIT.sub(" ", self.library.normalizer.normalize_str(text))
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower() has a rule for a sigma that ends a word
            text = text.replace("\x85", " ").replace("\xa0", " ")  # all others are unsure
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks between white space."""
        text = self.normal(text)
        if any(c in text for c in SEPARATORS):
            return [c for c in SPLIT.split(text) if c]
        return text.split()

    def pretokens(self, chunk: str) -> list[str]:
        """What the chunk is encoded as, one by one, in byte letters."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
            if chunk.isprintable():
                return self.pretoken.findall(chunk)
        if UNSURE.search(chunk):
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return [p.encode().decode("latin1").translate(self.translated) for p in self.pretoken.findall(chunk)]

class Counter(Words):
    """Token counts by byte-pair merging with a heap and a linked list; no ids of tokens are made."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.spec["model"]["vocab"]
        self.symbol = {c: (vocab[c], vocab[c + self.end]) for c in self.letters.values()}
        self.ranks = {}
        for rank, merge in enumerate(self.spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.of_pretoken = Memo("tokens", self.count_pretoken)
        self.of_chunk = Memo("tokens", lambda chunk: sum(map(self.of_pretoken.__getitem__, self.pretokens(chunk))))

    def count_pretoken(self, pretoken: str) -> int:
        symbols = [self.symbol[c][0] for c in pretoken]
        symbols[-1] = self.symbol[pretoken[-1]][1]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        """How many merges the symbols undergo: always the pair of the lowest rank, the leftmost of these."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0], k, pair[0], pair[1]) for k, pair in enumerate(itertools.pairwise(symbols)) if (found := ranks.get(pair))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[k], symbols[j] = ranks[left, right][1], -1
            after[k] = after[j]
            done += 1
            if after[k] >= 0:
                before[after[k]] = k
                if found := ranks.get((symbols[k], symbols[after[k]])):
                    heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]]))
            if before[k] >= 0 and (found := ranks.get((symbols[before[k]], symbols[k]))):
                heapq.heappush(heap, (found[0], before[k], symbols[before[k]], symbols[k]))
        return done

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.has_special(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.of_chunk.__getitem__, self.chunks(text)))


class Encoder(Words):
    """Token ids by the library, as little-endian unsigned 32-bit bytes.

    Texts go some at a time, until these have so many characters: each distinct chunk of theirs is split once, and
    pre-tokens that are not kept are encoded in bulk. About twice so many pre-tokens are kept: the older half goes
    when the newer is full.
    """

    def __init__(self, path: str, pretokens: int = 400_000, characters: int = 2**22):
        super().__init__(path)
        self.most, self.characters = pretokens, characters
        #: The library's model alone, for pre-tokens that are normalised already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        for token, k in self.library.get_vocab().items():
            self.ends[k] = token.endswith(self.end)
        #: For many chunks at once, a line feed after each: in any letters, and in ASCII.
        self.lines = regex.compile(self.pretoken.pattern + r"|\n")
        self.ascii_lines = re.compile(self.pretoken.pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9") + r"|\n")
        self.between = self.translated | {ord(c): c for c in " \n"}
        self.forget()
        keep("tokens", self.forget)

    def forget(self) -> None:
        self.of_pretoken, self.older = {"\n": b""}, {}

    def split(self, chunks: pa.Array) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all chunks, a line feed after each chunk's, and which place each chunk has among these."""
        plain = pc.and_(pc.string_is_ascii(chunks), pc.ascii_is_printable(chunks)).to_numpy(zero_copy_only=False)
        found, kind = chunks.to_numpy(zero_copy_only=False), np.where(plain, 0, 1)
        if UNSURE.search("".join(found[~plain])):
            kind[[k for k in np.flatnonzero(kind).tolist() if UNSURE.search(found[k])]] = 2
        out = self.ascii_lines.findall("\n".join([*found[kind == 0], ""]))
        if (others := found[kind == 1]).size:
            out += " ".join(self.lines.findall("\n".join([*others, ""]))).encode().decode("latin1").translate(self.between).split(" ")
        for chunk in found[kind == 2]:
            out += [*self.pretokens(chunk), "\n"]
        place = np.empty(len(kind), np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(kind))
        return out, place

    def known(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each; those of a line feed are none."""
        found = list(map(self.of_pretoken.get, pretokens))
        gaps = [k for k, b in enumerate(found) if b is None]
        lacking = {pretokens[k] for k in gaps}
        kept = {p: self.older[p] for p in lacking & self.older.keys()}
        if len(self.of_pretoken) + len(lacking) > self.most:
            self.older, self.of_pretoken = self.of_pretoken, {"\n": b""}
        self.of_pretoken.update(kept)
        new = list(lacking - kept.keys())
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            assert len(cuts) == len(some), "each pre-token ends with one word-end token"
            raw, start = ids.tobytes(), 0
            for p, stop in zip(some, (cuts * 4).tolist(), strict=True):
                self.of_pretoken[p], start = raw[start:stop], stop
        for k in gaps:
            found[k] = self.of_pretoken[pretokens[k]]
        return found

    def encode_normal(self, texts: list[str]) -> list[bytes]:
        """The ids of normalised texts without special strings, all at once."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = words.values.dictionary_encode()
        pretokens, place = self.split(chunks.dictionary)
        parts = self.known(pretokens)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.concatenate(([0], np.cumsum(sizes)[sizes == 0]))
        assert len(offsets) == len(place) + 1, "only the line feed after a chunk has no ids"
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
        _, starts, raw = ids.take(pa.array(place[chunks.indices.to_numpy()])).buffers()
        cuts = np.frombuffer(starts, np.int64)[words.offsets.to_numpy()].tolist()
        whole = memoryview(raw or b"")
        return [whole[a:b].tobytes() for a, b in itertools.pairwise(cuts)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, some, size = [], [], 0
        special = [bool(t) and self.has_special(t) for t in texts]
        for text, apart in zip(texts, special, strict=True):
            some.append("" if apart or not text else self.normal(text))
            size += len(some[-1])
            if size >= self.characters:
                out += self.encode_normal(some)
                some, size = [], 0
        if some:
            out += self.encode_normal(some)
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
