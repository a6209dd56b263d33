"""Words of many texts at once, as 64-bit digests, on whole byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes, which bounds the arrays.
GROUP_BYTES = 1 << 19

_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number; one to one."""
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums such that `run_digest` gives the digest of any run of bytes."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def run_digest(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of the byte runs [start, end); equal bytes give equal digests wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(_ODD))


def release_memory() -> None:
    """Give memory that Arrow and the C library hold unused back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only GNU's library has it
    if trim is not None:
        trim(0)


def groups(texts: Sequence[str | None], encode: Callable[[str], bytes], most: int = GROUP_BYTES):
    """(index of the first, encoded texts) of runs of texts that hold about `most` characters together.

    Only one run is encoded at a time; null is empty.
    """
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, [encode(x or "") for x in texts[start:i]]
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, [encode(x or "") for x in texts[start:]]


def word_digests(
    texts: Sequence[bytes], in_word: np.ndarray, most: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(digests, bounds): text i has the words bounds[i]:bounds[i + 1], of which the first `most` bytes count.

    `in_word` tells for each byte whether it belongs to words; a line feed must
    not. A long text is cut at word ends, so that arrays stay small.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = in_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    if most is not None:
        ends = np.minimum(ends, starts + most)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = np.empty(len(starts), _U)
    w = 0
    while w < len(starts):
        first = starts[w]
        upto = max(w + 1, int(np.searchsorted(ends, first + 2 * GROUP_BYTES, "right")))
        sums = prefix_sums(data[first : ends[upto - 1]])
        out[w:upto] = run_digest(sums, starts[w:upto] - first, ends[w:upto] - first)
        w = upto
    return out, np.searchsorted(starts, at)


def byte_class(pattern: bytes) -> np.ndarray:
    """For each byte whether `pattern` (a regular expression for one byte) matches it."""
    import re

    one = re.compile(pattern, re.S)
    return np.array([bool(one.fullmatch(bytes([b]))) for b in range(256)])


def window_digests(digests: np.ndarray, n: int) -> np.ndarray:
    """Digests of all runs of n consecutive words."""
    if len(digests) < n:
        return np.empty(0, _U)
    out = np.zeros(len(digests) - n + 1, _U)
    for k in range(n):
        out = mix(out * _U(_ODD) + digests[k : len(digests) - n + 1 + k] + _U(k + 1))
    return out
