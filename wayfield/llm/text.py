"""Words of UTF-8 text as NumPy arrays: the Arrow buffers of a batch are cut and hashed without a Python string.

A batch is handled in blocks of a few megabytes, or of one longer text. A long text is cut and hashed in pieces of 1 MB, and
a word that goes on in the next piece keeps its hash, so beside its own bytes a text needs memory for its words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates, and of words of letters and digits (every byte of a longer code point included).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def powers(size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers, and their inverses."""

    def grow(base: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            out[done : done + more] = out[:more] * step
            done += more
        return out

    return grow(_MULTIPLIER), grow(_INVERSE)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of some megabytes of text together: the rows, their bytes, and their offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


class Words:
    """Words of a block: ``starts`` and ``ends`` in bytes, ``rows`` (offsets into the words by row) and a 64-bit hash each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True):
        starts, ends, hashes = [], [], []
        # the last word of the piece before, if it may go on: its length and hash so far
        length, carried = 0, np.zeros(1, dtype=np.uint64)
        up, down = powers()
        for begin in range(0, len(data), PIECE):
            piece = data[begin : begin + PIECE]
            folded = LOWER[piece] if lower else piece
            inside = member[folded]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offsets[np.searchsorted(offsets, begin, side="left") : np.searchsorted(offsets, begin + len(piece), side="left")] - begin
            first[edges] = inside[edges]
            edges = edges[edges > 0]
            last[edges - 1] = inside[edges - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
            raw = (total[e] - total[s]) * down[s]
            if length and len(s) and s[0] == 0 and not (offsets == begin).any():
                raw[:1] *= np.uint64(pow(_MULTIPLIER, length, 1 << 64))
                raw[:1] += carried
                starts[-1], ends[-1], hashes[-1] = starts[-1][:-1], ends[-1][:-1], hashes[-1][:-1]
                s[0] = -length
            open_ = len(e) > 0 and e[-1] == len(piece)
            carried = raw[-1:].copy()
            length = int(e[-1] - s[-1]) if open_ else 0
            starts.append(s + begin)
            ends.append(e + begin)
            hashes.append(raw)

        def joined(parts: list[np.ndarray]) -> np.ndarray:
            whole = np.concatenate(parts or [np.zeros(0, dtype=np.int64)])
            parts.clear()
            return whole

        self.starts, self.ends = joined(starts), joined(ends)
        self.rows = np.searchsorted(self.starts, offsets)
        self.hashes = mix(joined(hashes).view(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and the index of each run's first word."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        total *= np.uint64(_MULTIPLIER)
        total += hashes[j : j + size]
    left = np.repeat(rows[1:], np.diff(rows))[:size] - np.arange(size)
    whole = np.flatnonzero(left >= n)
    return mix(total[whole]), whole


def row_slices(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Offsets by row into a list of rising word indices ``at``."""
    return np.searchsorted(at, rows)


def list_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)
