"""Ids of texts whose pieces are encoded independently; each different piece is encoded once and remembered.

Pieces are found by a hash, and their bytes are compared before remembered ids
are used: up to 16 bytes by the first and last 8 and the length, longer ones
byte by byte. A piece whose hash belongs to another piece is encoded by itself.
"""

from __future__ import annotations

import numpy as np

from . import words as W

REMEMBER = 400_000  #: pieces whose ids a worker keeps
SLOTS = 20  #: bits of the table that finds most pieces without sorting them


class Memo:
    """Subclasses say where pieces start (cut) and give the ids of new pieces (encoded)."""

    end: int | None = None  #: an id after each text
    kind = np.dtype("<i4")
    remember, slots = REMEMBER, SLOTS

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces of a chunk; every non-empty text starts one."""
        raise NotImplementedError

    def hashed(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return W.hashes_and_ends(buf, start, stop)

    def encoded(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the texts, their numbers of ids in that order, and the ids."""
        raise NotImplementedError

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.long: dict[int, bytes] = {}
        self.keys, self.index = np.zeros(1 << self.slots, np.uint64), np.zeros(1 << self.slots, np.int64)
        self.offset, self.flat = np.zeros(1, np.int64), np.zeros(0, self.kind)
        self.low, self.high, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        base = len(self.offset) - 1
        order, sizes, flat = self.encoded([x.decode() for x in texts])
        self.number.update(zip(hashes[order].tolist(), range(base, base + len(order)), strict=True))
        self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat.astype(self.kind)))
        self.low, self.high = np.concatenate((self.low, low[order])), np.concatenate((self.high, high[order]))
        self.bytes = np.concatenate((self.bytes, np.array([len(texts[i]) for i in order], np.int64)))
        for k, i in enumerate(order, base):
            if len(texts[i]) > 16:
                self.long[k] = texts[i]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and how many each text has."""
        start, n = self.cut(buf, offsets), len(offsets) - 1
        stop = np.append(start[1:], len(buf))
        h, low, high = self.hashed(buf, start, stop)
        slot = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        at = self.index[slot]
        miss = np.flatnonzero((self.keys[slot] != h) | (at >= len(self.offset) - 1))
        if len(miss):
            known, place, which = np.unique(h[miss], return_index=True, return_inverse=True)
            place, keys = miss[place], known.tolist()
            if len(self.number) + len(keys) > self.remember:  # start anew; this chunk's pieces are all looked up
                self.forget()
                miss = np.arange(len(h))
                known, place, which = np.unique(h, return_index=True, return_inverse=True)
                keys = known.tolist()
            new = np.array([i for i, k in enumerate(keys) if k not in self.number], np.int64)
            if len(new):
                p = place[new]
                raw = buf.tobytes()
                self._learn(known[new], [raw[a:b] for a, b in zip(start[p].tolist(), stop[p].tolist(), strict=True)], low[p], high[p])
            found = np.array([self.number[k] for k in keys])
            self.keys[slot[place]], self.index[slot[place]] = known, found
            at[miss] = found[which]
        length = stop - start
        wrong = (self.low[at] != low) | (self.high[at] != high) | (self.bytes[at] != length)
        longer = np.flatnonzero(~wrong & (length > 16))
        if len(longer):
            raw = buf.tobytes()
            wrong[longer] = [raw[a:b] != self.long[k] for a, b, k in zip(start[longer].tolist(), stop[longer].tolist(), at[longer].tolist(), strict=True)]
        if wrong.any():  # another piece has this hash
            some = np.flatnonzero(wrong)
            base = len(self.offset) - 1
            raw = [buf[start[i] : stop[i]].tobytes() for i in some.tolist()]
            order, sizes, flat = self.encoded([x.decode() for x in raw])
            offset, pieces = np.concatenate((self.offset, self.offset[-1] + np.cumsum(sizes))), np.concatenate((self.flat, flat.astype(self.kind)))
            at[some[np.array(order)]] = base + np.arange(len(order))
        else:
            offset, pieces = self.offset, self.flat
        size = offset[at + 1] - offset[at]
        row = np.searchsorted(offsets, start, "right") - 1
        total = int(size.sum())
        take = np.repeat(offset[at] - np.cumsum(size) + size, size) + np.arange(total)
        counts = np.bincount(row, size, n).astype(np.int64)
        if self.end is None:
            return pieces[take], counts
        out = np.full(total + n, self.end, self.kind)
        out[np.arange(total) + np.repeat(row, size)] = pieces[take]
        return out, counts + 1
