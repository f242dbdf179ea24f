"""Words of whole texts as numpy arrays: the shared front end of the text operators.

A word is a maximal run of bytes outside `\\x20` and `\\x09-\\x0D`, which on UTF-8 is the
regular expression `[^\\x20\\x09-\\x0D]+`.  Everything works on the Arrow buffers of a text
column, a bounded piece at a time, so no step holds more than one piece and its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: All bytes but those of letters (ASCII letters, and any character beyond ASCII).
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an unsigned array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES):
    """Slices of a batch with about `limit` bytes of text each (one longer text stands alone)."""
    offsets = buffers(batch.column(batch.schema.get_field_index(column)))[1]
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text counts as empty.  offsets[0] is 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=array.offset + len(array) + 1)[array.offset :]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a run of texts: `start`, `end` (byte offsets) and `first` (first word of each text, then the total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE):
        self.data = data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~between[data]
        n = len(data)
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            inner = offsets[offsets < n]
            before[inner] = False
        self.start = np.flatnonzero(solid & ~before)
        last = np.empty(n, dtype=bool)
        if n:
            last[-1] = True
            last[:-1] = ~solid[1:]
            cuts = offsets[1:][offsets[1:] > 0] - 1
            last[cuts] = True
        self.end = np.flatnonzero(solid & last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._solid = solid

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        head = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(head, length)
        power = np.ones(int(length.max()), dtype=np.uint64)
        with np.errstate(over="ignore"):
            power[1:] = _BASE
            power = np.cumprod(power, dtype=np.uint64)
            value = _BYTE[self.data[self._solid]] * power[place]
            return mix(np.add.reduceat(value, head) + length.astype(np.uint64))


    def exact(self) -> np.ndarray:
        """hashes(), but words of different bytes never share one: equal hashes are compared byte by byte."""
        h = self.hashes()
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        a, b = order[same], order[same + 1]
        length = self.end - self.start
        if (length[a] == length[b]).all():
            size = length[a]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            if (self.data[np.repeat(self.start[a], size) + place] == self.data[np.repeat(self.start[b], size) + place]).all():
                return h
        raw, ids = self.data.tobytes(), {}
        spans = zip(self.start.tolist(), self.end.tolist(), strict=True)
        return mix(np.array([ids.setdefault(raw[lo:hi], len(ids)) for lo, hi in spans], dtype=np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h: len(h) - k + 1 values (none if fewer)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, have, power = None, 0, h
        size, base = 1, _BASE
        rest, n = k, len(h)
        while rest:
            if rest & 1:
                part = power[have : have + n - k + 1]
                out = part.copy() if out is None else out * base + part
                have += size
            rest >>= 1
            if rest:
                power = power[: len(power) - size] * base + power[size:]
                base = base * base
                size *= 2
        return mix(out, k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur
