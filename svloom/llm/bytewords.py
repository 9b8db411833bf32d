"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Whitespace that ends a word: space and \\x09-\\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits ends a word.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: A-Z to a-z; other bytes stay.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_rng = np.random.default_rng(0x5EED)
_CODE = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
_STEP = int(_rng.integers(0, 2**64, dtype=U)) | 1
_BACK = pow(_STEP, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACE, stems: tuple[int, ...] = ()):
    """(64-bit hash of each word in lower case, n + 1 offsets of the texts' words); ``ends``: bytes between words.

    With ``stems`` a third result: for each of these lengths the hashes of the words' first bytes.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, U), np.zeros(len(offsets), np.int64)
        return (*none, [none[0] for _ in stems]) if stems else none
    inside = ~ends[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum(_CODE[LOWER[data]] * _powers_of(_STEP, n), out=sums[1:])
    back, at = _powers_of(_BACK, n)[start], np.searchsorted(start, offsets)

    def upto(end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * back + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    if stems:
        return upto(end), at, [upto(np.minimum(end, start + k)) for k in stems]
    return upto(end), at


_PLACE = _rng.integers(0, 2**64, 9, dtype=U) | U(1)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    m = len(hashes)
    total = np.zeros(max(m - width + 1, 0), U)
    for j in range(width):
        total += hashes[j : j + len(total)] * _PLACE[j]
    total = mix(total + U(width))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def slices(texts: pa.Array, size: int = 1 << 18):
    """(first, last) row ranges whose texts together have about ``size`` bytes, or one longer text."""
    _, offsets = column(texts)
    first, rows = 0, len(texts)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)
