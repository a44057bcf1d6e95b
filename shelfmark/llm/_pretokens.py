"""Byte-level pre-tokens and their ids, as a byte-level BPE file of the tokenizers library defines them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

CACHE_ENTRIES = 1 << 19

# Texts of these characters alone (ASCII without odd controls, Latin letters) are cut by a byte pattern: in them every
# byte from 0x80 on is part of a letter. Other texts go to the library whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ɏ]*")
# Fixed value: the byte-level pre-token pattern, for such bytes.
_PIECES = re.compile(
    rb"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\s0-9A-Za-z\x80-\xff]+|\s+(?!\S)|\s+"
)


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _letters() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Pieces(dict):
    """Pre-token (bytes) to its ids as little-endian 32-bit numbers; fills itself, within a bound."""

    def __init__(self, tokenizer: Tokenizer, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries
        self.model = tokenizer.model
        self.letters = _letters()

    def __missing__(self, piece: bytes) -> bytes:
        ids = [token.id for token in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        value = np.array(ids, dtype="<u4").tobytes()
        if len(self) >= self.entries:
            self.clear()
        self[piece] = value
        return value


class Encoder:
    """Texts to ids, with the strings of special tokens treated as the library treats them."""

    def __init__(self, path: str, pieces: Callable[[Tokenizer], dict] = Pieces):
        self.tokenizer = load(path)
        self.cache = pieces(self.tokenizer)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(token.content) for token in added.values())) if added else None

    def pieces(self, text: str) -> list[bytes] | None:
        """The pre-tokens of a plain text; None if the library has to see the whole text."""
        if not _PLAIN.fullmatch(text) or (self.special and self.special.search(text)):
            return None
        return _PIECES.findall(text.encode())

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        pieces = self.pieces(text)
        if pieces is None:
            return np.array(self.whole(text), dtype="<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
