"""Encoding with the tokenizers library, remembering words.

A text is cut at spaces that are followed by something other than white space.  Both kinds of
tokenizer handled here split a text at such places anyway, so the pieces can be encoded apart and the
ids put together; most pieces repeat, and their ids come from a bounded cache.  Every id is the
library's own.  A text in which that rule can't be seen to hold (runs of spaces, odd control
characters, special tokens, another kind of tokenizer) is encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed value: the published splitting pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Text on which all Unicode versions and both lower-casings agree: ASCII and Latin letters, no combining marks.
PLAIN = re.compile("[\n\t!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f]*")
ODD = regex.compile("[\x1c-\x1f\x85\xa0]")
PIECES, WORDS = 800_000, 600_000


def _byte_signs() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


class _Whole(Exception):
    pass


class _Cache(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives little-endian ids of ``dtype`` as bytes."""

    def __init__(self, path: str, words: int = WORDS, pieces: int = PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.lead = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            self.lead, self.pattern = " ", regex.compile(BYTE_LEVEL_PATTERN)
        elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            split = pre["pretokenizers"][0]
            if split["behavior"] == "Removed" and split["invert"] and not pre["pretokenizers"][1]["use_regex"]:
                self.lead, self.pattern = "", regex.compile(split["pattern"]["Regex"])
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.word = _Cache(self._word, words)
        self.first = _Cache(lambda piece: self._piece(piece, ""), pieces)
        self.rest = _Cache(self._rest, pieces)

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word (what the splitting pattern gives), from the library's model itself."""
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()

    def _rest(self, piece: str) -> bytes:
        if self.lead and (not piece or piece[0].isspace()):
            raise _Whole
        return self._piece(piece, self.lead)

    def _piece(self, piece: str, lead: str) -> bytes:
        if not piece:
            return b""
        if not PLAIN.fullmatch(piece):
            if ODD.search(piece):
                raise _Whole
            return self._library(lead + piece)
        if not self.lead:
            piece = piece.lower()
        if piece.isalpha():
            return self.word[lead + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return self.word[lead + piece[:-1]] + self.word[piece[-1]]
        word = self.word
        return b"".join([word[w] for w in self.pattern.findall(lead + piece)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.lead is None or any(s in text for s in self.special):
            return self._library(text)
        pieces = text.split(" ")
        try:
            head = self.first[pieces[0]]
            if len(pieces) == 1:
                return head
            del pieces[0]
            return head + b"".join(map(self.rest.__getitem__, pieces))
        except _Whole:
            return self._library(text)

    def ids(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        tail = b"" if end_id is None else int(end_id).to_bytes(self.dtype.itemsize, "little")
        return np.frombuffer(self.encode(text) + tail, dtype=self.dtype)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process; its cache lasts from task to task."""
    return Encoder(path)


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
