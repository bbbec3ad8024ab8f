"""Words, shingles and hashes that the operators of this subpackage share.

*Words* are maximal runs of letters and digits, lower-cased. Hashes are 64-bit and
the same in every process; NumPy does the arithmetic over whole texts at a time.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
U = np.uint64
_C1, _C2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def salt(*parts: int) -> np.uint64:
    """A 64-bit constant from small integers."""
    x = 0
    for p in parts:
        x = (x * 0x100000001B3 + p + 1) * _GOLD & _MASK
        x ^= x >> 29
    return U(x)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in [0, 1)."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53


class WordHashes:
    """Word to hash with a memo that is emptied when it has grown to ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.memo: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        out = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order (repeats kept)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    x = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        x = mix(x * U(0x100000001B3) + h[j : j + n])
    return x


def text_key(h: np.ndarray) -> int:
    """One signed 64-bit key of a whole word sequence; equal sequences, equal keys."""
    return signed(xxhash.xxh3_64_intdigest(h.tobytes()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_hash(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


def small(df: "DataFrame", most: int = 100_000) -> "DataFrame":  # noqa: F821
    """``df``, written down and, where it is known to have ``most`` rows or fewer, marked
    for broadcast; larger ones are joined by shuffle."""
    from pyspark.sql import functions as F

    from scriptoria.session import cut

    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def lists(values: np.ndarray, lengths) -> "pyarrow.Array":  # noqa: F821
    """A list<int64> Arrow array of concatenated values and their lengths."""
    import pyarrow as pa

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(values)))
