"""Vectorised views of Arrow text batches: bytes, words and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = np.random.default_rng(20240521).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: The field of the rolling hashes, and a seeded base for each of two of them.
PRIME = 2**31 - 1
_BASES = tuple(int(x) for x in np.random.default_rng(20240607).integers(2**20, PRIME - 1, 2))
_POWERS: list[np.ndarray] = [np.ones(1, U64) for _ in range(4)]


def modulo(x: np.ndarray) -> np.ndarray:
    """Numbers under 2**62 modulo ``PRIME``."""
    low = U64(PRIME)
    x = (x & low) + (x >> U64(31))
    x = (x & low) + (x >> U64(31))
    return np.where(x >= low, x - low, x)


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers modulo ``PRIME`` of both bases, and of their inverses."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate([*_BASES, *(pow(x, -1, PRIME) for x in _BASES)]):
            table = _POWERS[k]
            _POWERS[k] = np.concatenate([table, modulo(table * U64(pow(base, len(table), PRIME)))])
    return [x[:n] for x in _POWERS]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes, from prefix sums.

    Each hash is two polynomials over a prime field with seeded bases, one over the codes' low bits and one over
    their high bits: 62 bits, which no structure of the sequence lessens (modulo a power of two, sequences such
    as that of Thue and Morse meet their complement at any base).
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        table = powers(n + 1)
        self.down, self.prefix = table[2:], []
        for k, part in enumerate((codes & U64(PRIME), codes >> U64(33))):
            total = np.zeros(n + 1, U64)
            np.cumsum(modulo(part * table[k][:n]), dtype=U64, out=total[1:])
            self.prefix.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (modulo(modulo(p[end] - p[start]) * d[start]) for p, d in zip(self.prefix, self.down, strict=True))
        return mix((low | high << U64(32)) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each; a null has none."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first, last, bytes, offsets)`` of a batch of at most about ``limit`` bytes, one whole text at least."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` and the number of its text."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    full = ~space
    starts, ends = np.flatnonzero(full & before), np.flatnonzero(full & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's bytes: the sum of a scrambled number for each byte at its place, so that no pattern cancels."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    length = ends - starts
    edge = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], length)
    total = np.zeros(edge[-1] + 1, U64)
    np.cumsum(mix(BYTE_CODE[data[np.repeat(starts, length) + place]] + place.astype(U64) * U64(0x9E3779B97F4A7C15)), dtype=U64, out=total[1:])
    return mix(total[edge[1:]] - total[edge[:-1]] + length.astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
