"""Hashed words and shingles of whole texts, vectorised inside tasks.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lowered. All hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = 2**64 - 1
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SHINGLE = [pow(0xD1342543DE82EF95, k, 2**64) for k in range(64)]


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", _STEP), ("down", _BACK)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a UTF-8 text."""
    if not data:
        return np.zeros(0, np.uint64)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def prefix_hashes(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """The words' hashes, then for each length the hashes of the words' leading bytes (a shorter word as a whole)."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(data) if data else (np.zeros(0, np.int64),) * 2
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    base, back = total[starts], down[starts]
    return [mix((total[ends] - base) * back)] + [mix((total[np.minimum(ends, starts + k)] - base) * back + np.uint64(k)) for k in lengths]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for each run of width words in text order; a shorter text is one shingle; no words, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * np.uint64(_SHINGLE[i + 1])
    return mix(out)


def to_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def columns(batches: Iterator, *names: str) -> Iterator[list]:
    """Python lists of the named columns of Arrow batches, in slices of at most 256 rows, so long texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
