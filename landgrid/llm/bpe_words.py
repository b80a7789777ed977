"""Exact fast paths for the two ``tokenizers`` files: cached words for common text, the library itself for all other text.

Both files cut a text into words by a pattern and encode each word alone, so a word's ids can be kept. For characters
below U+0180 the patterns' classes are written out here and words are merged by rank with ``tiktoken``; a text with any
other character, or with a special token's string, goes to ``tokenizers`` whole. Tests hold both paths together.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

from landgrid.llm._util import held

TOKENIZER_DIR = "/opt/tokenizers"
KEPT_WORDS, KEPT_LENGTH = 150_000, 48  # of the word cache of one worker; what does not fit is encoded each time


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"


def _kinds(start: str) -> str:
    return re.escape("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == start))


_L, _N, _S = _kinds("L"), _kinds("N"), "\t-\r \x85\xa0"
#: What the fast paths take. U+0130 becomes two characters in lower case, U+001C to U+001F are white space to some engines.
_OTHER = re.compile("[^\0-\x1b\x20-įı-ſ]")
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(f"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_PLAIN = re.compile(f"{_ENDS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Words(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        out = self.make(word)
        if len(word) <= KEPT_LENGTH and len(self) < KEPT_WORDS:
            self[word] = out
        return out


class ByteBpe:
    """byte_bpe_50k.json: ids as tokenizers gives them without added special tokens."""

    def __init__(self, folder: str | None = None):
        self.file = tokenizer_path("byte_bpe_50k.json", folder)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken", folder), "rb"))}
        self.encode_word = _ranked(self.ranks)
        self.counts = _Words(lambda w: len(self.encode_word(w.encode())))
        self.special = "<|endoftext|>"
        self.lengths = [0] * (max(self.ranks.values()) + 2)  # bytes of each token
        for token, i in self.ranks.items():
            self.lengths[i] = len(token)
        self.lengths[50256] = len(self.special)
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.file)
        return self._library

    def fast(self, text: str) -> bool:
        return text.isascii() and "<|endof" not in text and not _OTHER.search(text) or not _OTHER.search(text) and self.special not in text

    def count(self, text: str) -> int:
        if self.fast(text):
            return sum(map(self.counts.__getitem__, _SPACED.findall(text)))
        return len(self.library().encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> list[int]:
        if self.fast(text):
            return [i for w in _SPACED.findall(text) for i in self.encode_word(w.encode())]
        return self.library().encode(text, add_special_tokens=False).ids


class WordBpe:
    """word_bpe_49k.json: packed little-endian unsigned 32-bit ids. Lower case, white space dropped, words marked at their ends."""

    SLICE = 1 << 18

    def __init__(self, folder: str | None = None):
        self.file = tokenizer_path("word_bpe_49k.json", folder)
        data = json.load(open(self.file, encoding="utf-8"))
        self.special = [x["content"] for x in data["added_tokens"]]
        at, end, mark = _byte_chars(), "</w>", b"\xff"  # a byte that UTF-8 never has stands for the end of a word
        ranks = {}
        for token, i in data["model"]["vocab"].items():
            if token not in self.special:
                body = token.removesuffix(end)
                ranks[bytes(at[c] for c in body) + mark * (body != token)] = i
        one = _ranked(ranks)

        def make(word: str) -> bytes:
            ids = one(word.encode() + mark)
            return struct.pack(f"<{len(ids)}I", *ids)

        self.packed = _Words(make)
        self._library = None

    def _slow(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.file)
        ids = self._library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _slices(self, text: str) -> Iterator[str]:
        """Parts cut at white space, which no word or special token holds: bounded memory for texts of any length."""
        at = 0
        while len(text) - at > self.SLICE:
            cut = re.compile(r"[ \t\n\r]").search(text, at + self.SLICE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        out = []
        for part in self._slices(text):
            if _OTHER.search(part) or "<|" in part and any(s in part for s in self.special):
                out.append(self._slow(part))
            else:
                out.append(b"".join(map(self.packed.__getitem__, _PLAIN.findall(part.lower()))))
        return b"".join(out)


def loaded(kind: type, folder: str | None = None):
    """One instance a worker process."""
    return held((kind, folder), lambda: kind(folder))
