"""Words of whole Arrow text columns as numpy arrays of byte positions and hashes.

A batch of texts is one byte buffer with offsets. Words are maximal runs of
the bytes that a 256-entry table admits. Their 64-bit hashes chain the 8-byte
lanes of a word through `mix`, for all words of a batch at once, so no Python
object is made per word. Hashes of runs of words join the hashes of two shorter
runs, again through `mix`. Neither is a polynomial, so no two texts collide by
construction; where a result depends on equality, two such hashes of different
lanes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 512  #: a word of more bytes is hashed by blake2b
CHUNK = 1 << 20  #: bytes of text handled at a time

#: [^\x20\x09-\x0D]
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
LANES = (0, 1)  #: independent hashes of runs of words


def _lean() -> None:
    """Give freed memory back to the system, so that a worker that many stages use stays small."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


_lean()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def split(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of every text (n + 1 numbers)."""
    n = len(buf)
    w = np.zeros(n + 2, bool)
    w[1:-1] = inside[buf]
    first = w[1:-1] & ~w[:-2]
    last = w[1:-1] & ~w[2:]
    cut = offsets[(offsets > 0) & (offsets < n)]  # texts that touch
    first[cut] |= w[1:-1][cut]
    last[cut - 1] |= w[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position of buf, as little-endian numbers; past its end they are 0."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))


def ends_of(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 bytes of each span; with its length they tell all of a span of up to 16 bytes."""
    n = ends - starts
    return eight[starts] & _MASK[np.minimum(n, 8)], np.where(n > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return hashes_and_ends(buf, starts, ends, fold)[0]


def hashes_and_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of byte spans, and their first and last 8 bytes (`ends_of`)."""
    if not len(starts):
        return tuple(np.zeros(0, np.uint64) for _ in range(3))
    if fold is not SAME:
        buf = fold[buf]
    n, eight = ends - starts, lanes(buf)
    low, high = ends_of(eight, starts, ends)
    out = mix(mix(low + n.astype(np.uint64) * _K[0]) * _K[1] + (high ^ _K[2]))
    at, live = 8, np.flatnonzero(n > 16)
    while len(live):  # the bytes between the first and the last 8
        out[live] = mix(out[live] * _K[1] + (eight[starts[live] + at] ^ _K[3]))
        at += 8
        live = live[n[live] > at + 8]
        if at > LONG:
            for i in live.tolist():
                out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            break
    return out, low, high


def _joined(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    return mix(a * _K[2 + lane] + mix(b ^ _K[lane]))


def runs(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of the k words from each position on; len(words) - k + 1 of them."""
    return spans(words, np.arange(max(len(words) - k + 1, 0)), np.full(max(len(words) - k + 1, 0), k), lane)


def spans(words: np.ndarray, start: np.ndarray, n: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of runs of n words (0 or more) from start on: of two runs of a power of two that cover them, and of n."""
    out = np.zeros(len(start), np.uint64)
    level, size = words, 1
    most = int(n.max()) if len(n) else 0
    while size <= most:
        at = np.flatnonzero((n >= size) & (n < 2 * size))
        if len(at):
            s = start[at]
            out[at] = _joined(level[s], level[s + n[at] - size], lane) + n[at].astype(np.uint64) * _K[3 - lane]
        size *= 2
        if size <= most:
            level = _joined(level[: len(level) - size // 2], level[size // 2 :], lane)
    return out


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """Every position at which k consecutive words of one text start. first: as from `split`."""
    n = np.maximum(first[1:] - first[:-1] - k + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return at + np.arange(n.sum())


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each i, the leftmost position of the least of values[i : i + w]."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < w:
        step = min(size, w - size)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        size += step
    return at[:n]
