"""Sets of five-word shingles as 64-bit keys, made in numpy inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WIDTH = 5
_KNOWN_WORDS = 300_000
_ODD = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, with only A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def digest(found: list[bytes]) -> bytes:
    """Sixteen bytes that name a word sequence."""
    return hashlib.md5(b" ".join(found)).digest()


def keys(found: list[bytes]) -> np.ndarray:
    """Sorted distinct shingle keys; a sequence shorter than a shingle is one key; none without words."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    at = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    if len(at) < WIDTH:
        mixed = (at * _ODD[: len(at)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(at))
    else:
        n = len(at) - WIDTH + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for i in range(WIDTH):
            mixed += at[i : i + n] * _ODD[i]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    return np.unique(mixed ^ (mixed >> np.uint64(33)))


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as byte planes of their differences: most planes are zero and compress away."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T[:6].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)
