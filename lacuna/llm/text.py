"""Vectorised views of Arrow text columns: bytes, words and rolling hashes, a bounded slice of rows at a time.

Everything works on the UTF-8 bytes of whole texts.  Word separators are the six ASCII white-space bytes
(0x20, 0x09-0x0D), which never occur inside a multi-byte character, so byte work and code-point work agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # text bytes handled at once; numpy temporaries are 40 to 200 bytes for each
KEPT_POWERS = (1 << 20) + (1 << 15)  # powers that a worker keeps between batches; longer texts make more for themselves

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; the first ``KEPT_POWERS`` at most are kept per worker process, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, min(2 * len(have) if have is not None else 1 << 16, KEPT_POWERS))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def give_back() -> None:
    """Returns memory that nothing uses to the system: a worker lives through many stages, beside others' heaps."""
    for base in [b for b, p in _powers.items() if len(p) > KEPT_POWERS]:
        del _powers[base]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(rows, data, offsets)`` for runs of rows holding about ``limit`` text bytes (one row at least).

    ``data`` are the concatenated UTF-8 bytes of ``column`` (null: empty), ``offsets`` has one more entry than rows.
    """
    if batch.num_rows == 0:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    _, raw, body = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield batch.slice(at, to - at), data[lo:hi], offsets[at : to + 1] - lo
        at = to
    del data, texts
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words do not cross rows."""
    inside = ~_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each row's first item among sorted ``starts`` (one more entry than rows)."""
    return np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; ``len(data) + 1`` entries."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte span, the same wherever the bytes stand."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring hashes (row edges are the caller's)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
