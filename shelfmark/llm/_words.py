"""Words and word shingles of texts as 64-bit numbers, without a Python object per word.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. Its number is a polynomial in its bytes, modulo 2**64 and then mixed, so
equal words have equal numbers wherever they stand; different words share one with a chance
of about 2**-64.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 18
WHITE_BYTES = b" \t\n\x0b\x0c\r"
WHITE = np.zeros(256, dtype=bool)
WHITE[list(WHITE_BYTES)] = True
_WHITE_RUN = re.compile(rb"[ \t\n\x0b\x0c\r]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_U64 = (1 << 64) - 1


def mix(numbers: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (a one-to-one map)."""
    x = numbers ^ (numbers >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS = _powers(_BASE, CHUNK + 1)
_INVERSES = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and start positions of the words of at most CHUNK bytes."""
    codes = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = ~WHITE[codes]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * _POWERS[: len(codes)], dtype=np.uint64, out=sums[1:])
    numbers = (sums[ends] - sums[starts]) * _INVERSES[starts]
    return mix(numbers + (ends - starts).astype(np.uint64) * _GOLDEN), starts


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """Word numbers of a long text, in chunks that end at white space."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            end = max(data.rfind(bytes([c]), at, end) for c in WHITE_BYTES) + 1
        if end <= at:  # one word longer than a chunk
            found = _WHITE_RUN.search(data, at)
            end = found.start() if found else len(data)
            digest = hashlib.blake2b(data[at:end], digest_size=8).digest()
            yield np.frombuffer(digest, dtype="<u8").astype(np.uint64)
        else:
            yield _chunk(data[at:end])[0]
        at = end


def word_numbers(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts, and where each text's begin (one more entry: the end)."""
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    parts: list[np.ndarray] = []
    waiting: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            joined = b" ".join(texts[i] for i in waiting)
            numbers, starts = _chunk(joined)
            begins = np.cumsum([0] + [len(texts[i]) + 1 for i in waiting])
            places = np.searchsorted(starts, begins)
            counts[np.array(waiting) + 1] = np.diff(places)
            parts.append(numbers)
            waiting.clear()
            size = 0

    for i, text in enumerate(texts):
        if size + len(text) + 1 > CHUNK:
            flush()
        if len(text) + 1 > CHUNK:
            for numbers in _pieces(text):
                parts.append(numbers)
                counts[i + 1] += len(numbers)
        else:
            waiting.append(i)
            size += len(text) + 1
    flush()
    numbers = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return numbers, np.cumsum(counts)


def windows(numbers: np.ndarray, words: int) -> np.ndarray:
    """A number for every run of so many words; entry i begins at word i (runs cross texts)."""
    if len(numbers) < words:
        return np.zeros(0, dtype=np.uint64)
    last = len(numbers) - words + 1
    out = mix(numbers[:last] + np.uint64(words))
    for step in range(1, words):
        out = mix(out * _GOLDEN + numbers[step : last + step])
    return out


def distinct(numbers: np.ndarray) -> np.ndarray:
    if len(numbers) < 2:
        return numbers
    ordered = np.sort(numbers)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def shingle_sets(texts: Sequence[bytes], words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending. A text with fewer words has one: all its words."""
    numbers, begins = word_numbers(texts)
    runs = windows(numbers, words)
    for at, end in zip(begins[:-1], begins[1:], strict=True):
        if end - at >= words:
            yield distinct(runs[at : end - words + 1])
        else:
            yield windows(numbers[at:end], int(end - at)) if end > at else numbers[:0]
