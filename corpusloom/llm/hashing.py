"""Vectorised 64-bit hashes of the words of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E6C63D0876A68ED)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_BYTES[_SPACE == 1] = 0
#: Bytes of text hashed at once; a longer text is cut between words.
CHUNK = 1 << 20
#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 64)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def _hash_buffer(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a buffer."""
    raw = np.frombuffer(buf, np.uint8)
    edge = np.diff(1 - _SPACE[raw], prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space (a single word longer than a piece stays whole)."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + CHUNK)) >= 0]
            cut = min(found) if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Over groups of neighbouring texts: (index of the first, hashes of all words, words before each
    text and in all). Memory follows the longest text, not the number of texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) + 1 <= CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            hashes = [_hash_buffer(p)[1] for p in (_pieces(texts[i]) if len(texts[i]) > CHUNK else [texts[i]])]
            h = np.concatenate(hashes)
            yield i, h, np.array([0, len(h)])
        else:
            start, h = _hash_buffer(b"\n".join(texts[i:j]))
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            yield i, h, np.r_[0, np.searchsorted(start, ends)]
        i = j


def bytes_of(texts) -> list[bytes]:
    """UTF-8 of a pandas column of texts, null as empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]
