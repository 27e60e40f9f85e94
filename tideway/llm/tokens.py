"""Token ids of texts by the tokenizers library, with a memory of chunks already seen.

A byte-level BPE never merges across its pre-tokens, and every single space
between two visible characters starts one. So a text is the chunks that such
spaces divide, and its ids are the ids of its chunks in a row. Each worker
keeps the ids of the chunks it met; only new ones go through the library.
Texts where this does not hold (longer runs of white space, the strings of
special tokens) are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

DEFAULT = "byte_bpe_50k.json"
#: Chunks that each half of a worker's memory keeps.
KEEP = 500_000
#: Without these, no space has other white space beside it.
SPACES = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: itself where printable, else the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """What follows a space -> bytes of the ids (unsigned 16 or 32 bits) of the space and it. What was not asked for lately is forgotten.

    A chunk of several pre-tokens is put together from theirs, which are kept
    too: a word before a comma is the word that stands alone elsewhere.
    """

    def __init__(self, tok, dtype, pattern):
        self.tokenize, self.code, self.old, self.bare = tok.model.tokenize, "H" if dtype.itemsize == 2 else "I", {}, {}
        self.pattern, self.letters = pattern, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            if chunk.isalpha():
                got = self.ids(" " + chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ".,":
                got = self[chunk[:-1]] + self.piece(chunk[-1])
            else:
                first, *rest = self.pattern.findall(" " + chunk)
                got = (self[first[1:]] if rest else self.ids(first)) + b"".join([self.piece(p) for p in rest])
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def head(self, chunk: str) -> bytes:
        """The ids of what starts a text."""
        return b"".join([self.piece(p) for p in self.pattern.findall(chunk)])

    def piece(self, p: str) -> bytes:
        """The ids of one pre-token."""
        if p[0] == " ":
            return self[p[1:]]
        got = self.bare.get(p)
        if got is None:
            if len(self.bare) >= KEEP:
                self.bare.clear()
            got = self.bare[p] = self.ids(p)
        return got

    def ids(self, p: str) -> bytes:
        mapped = (p if p.isascii() else p.encode().decode("latin-1")).translate(self.letters)
        return array(self.code, [x.id for x in self.tokenize(mapped)]).tobytes()


class Encoder:
    """encode(text) gives ids as bytes of ``dtype``, little-endian."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.odd = re.compile(r"\s\s\s|\s\s\Z")
        #: The published pattern of byte-level pre-tokens.
        self.chunks = Chunks(self.tok, self.dtype, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or any(x in text for x in self.special) or any(x in text for x in SPACES) and self.odd.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.chunks.head(first) + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)
