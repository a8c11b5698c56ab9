"""Language-model scores from an Elias-Fano trie of n-grams in memory-mapped files.

Counting: tasks count words, word pairs and word triples of their texts with NumPy and send sorted, packed counts to shards
by hash (a frequent word's pairs and triples are spread over all shards). Each shard is merged by one task, bounded by
``shard_bytes`` of text per shard, and written as one file. The first level holds all words (hash, exact count), the second,
for each context word of the shard, its successors, the third the successors of each such pair. The third level keeps the
triples that occur twice or more. Both pairs of such a triple do so too: shards write a bit table of their pairs of that
kind, and a triple that has a pair outside the tables is not sent. The tables may pass too much, never too little; counts decide.

Files: sorted lists are Elias-Fano coded (low bits packed, high parts in unary with a directory of zeros). A context's
successors are the range between two monotone pointers, and a word is searched in that range alone; entries are context
number and 40-bit word hash together, so the list rises over the whole shard. Each has a 16-bit code of its probability.

Model: P(w | v) = c(vw) / (c(v) + mu) + mu / (c(v) + mu) * P(w), with P(w) = (c(w) + 1) / (N + V + 1): Dirichlet smoothing,
so a context that was never seen leaves P(w). The first summand is what is coded, rounded down in steps of 0.001 in log10
(16 bits reach 65 decades, more than any count), so sums over w stay at most 1. A pair uv with kept triples uvw has
P(w | uv) = c(uvw) / (c(uv) + nu) + (1 - kept / (c(uv) + nu)) * P(w | v), where kept is the sum of its kept counts: what the
dropped triples leave goes to the level above, and sums stay at most 1. c(uv) is read back from its code, exact up to about
430 and at most 0.3 % high beyond. A text is its words (A-Z lower-cased) and one end.

Scoring is a map: files are opened by memory map where the shared folder is mounted, elsewhere through an unlinked local
copy, at most ``MAPPED`` at a time in a worker; some blocks of text together are looked up shard by shard, so the files that a
task goes through grow with the corpus as its own text does not. Null texts are empty, and an empty text is scored as its end. An empty
training set gives P(w) = 1 / 1 for any word. Rows are scored one by one, so repeated rows and ids do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.store import fresh, mapped, put, written
from wayfield.llm.text import NOT_SPACE, Words, blocks, mix

END, BEGIN = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x0B060B060B060B06)
NEXT_BITS = 40
STEP = 0.001
MAPPED = 1024
#: Tokens that are looked up at once.
SLICE = 1 << 20
MU = 300.0
#: Weight of the level above for a context of two words.
NU = 3.0
ONE = np.uint64(1)

_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_set)] = _set
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A rising list of 64-bit numbers; ``find`` gives the index of each equal entry, or -1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        shift = np.uint64(low_bits)
        low = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
        if low_bits:
            part = values & ((ONE << shift) - ONE)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << bit)
            over = bit + shift > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - bit[over]))
        place = (values >> shift).astype(np.int64) + np.arange(n)
        size = (universe >> low_bits) + n + 2
        bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)])[:-1]
        return EliasFano(n, low_bits, low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low_bits
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> bit
        # a shift by 64 is not defined: move by one bit first
        value |= (self.low[word + 1] << ONE) << (np.uint64(63) - bit)
        return value & ((ONE << np.uint64(self.low_bits)) - ONE)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of zero number k (from 0) among the high parts."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = k - self.zeros[word]
        inside = (~self.high[word]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_ONES[inside], axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[inside[rows, byte], left]

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """``begin`` and ``stop``: search each only in its own range of indices."""
        if not self.n or not len(x):
            return np.full(len(x), -1, dtype=np.int64)
        shift = np.uint64(self.low_bits)
        part = (x >> shift).astype(np.int64)
        lo = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) - part + 1, 0)
        hi = self._zero(part) - part
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, stop)
        end = hi.copy()
        low = x & ((ONE << shift) - ONE)
        # successor among the entries with the same high part
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out = np.full(len(x), -1, dtype=np.int64)
        there = np.flatnonzero(lo < end)
        same = self._low(lo[there]) == low[there]
        out[there[same]] = lo[there[same]]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The entries at these indices."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        inside = self.high[word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_ONES[inside], axis=1, dtype=np.int64)
        left = i - ones[word]
        byte = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(i))
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        place = word * 64 + byte * 8 + _SELECT[inside[rows, byte], left]
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def parts(self) -> tuple[dict, list[np.ndarray]]:
        return {"n": self.n, "low_bits": self.low_bits}, [self.low, self.high, self.zeros]


def pack(meta: dict, arrays: list[np.ndarray]) -> bytes:
    """A header line with the arrays' kinds and sizes, then the arrays, each on an 8-byte boundary."""
    head = json.dumps(meta | {"arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def unpack(data: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    at = 0
    while data[at] != 10:
        at += 1
    meta, at, arrays = json.loads(data[:at].tobytes()), at + 1, []
    for kind, n in meta["arrays"]:
        size = np.dtype(kind).itemsize * n
        arrays.append(data[at : at + size].view(kind))
        at += -(-size // 8) * 8
    return meta, arrays


@lru_cache(maxsize=MAPPED)
def _words_level(folder: str, name: str) -> tuple[EliasFano, np.ndarray]:
    meta, (low, high, zeros, counts) = unpack(mapped(folder, name))
    return EliasFano(meta["n"], meta["low_bits"], low, high, zeros), counts


class Pairs:
    """The lower level of one shard: contexts, pointers to their successors, the successors, and a code for each."""

    def __init__(self, data: np.ndarray):
        meta, arrays = unpack(data)
        lists = [EliasFano(m["n"], m["low_bits"], *arrays[3 * i : 3 * i + 3]) for i, m in enumerate(meta["lists"])]
        self.context, self.pointer, self.successor = lists
        self.code = arrays[9]

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        new = np.append(True, context[1:] != context[:-1])
        known, rank = context[new], np.cumsum(new) - 1
        lists = [
            EliasFano.build(known, 1 << 64), EliasFano.build(np.append(np.flatnonzero(new), len(context)).astype(np.uint64), len(context) + 1),
            EliasFano.build((rank.astype(np.uint64) << np.uint64(NEXT_BITS)) | word, len(known) << NEXT_BITS),
        ]
        parts = [x.parts() for x in lists]
        return pack({"lists": [p[0] for p in parts]}, [a for p in parts for a in p[1]] + [code])

    def successors(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes (40 bits) and codes after one context: the range between its pointers."""
        rank = self.context.find(np.array([context], dtype=np.uint64))
        if rank[0] < 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)
        begin, end = self.pointer.get(np.append(rank, rank + 1)).astype(np.int64)
        return self.successor.get(np.arange(begin, end)) & ((ONE << np.uint64(NEXT_BITS)) - ONE), self.code[begin:end]

    def place(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The index of each pair among the successors, or -1."""
        known, which = np.unique(context, return_inverse=True)
        rank = self.context.find(known)
        begin, stop = np.zeros((2, len(known)), dtype=np.int64)
        seen = np.flatnonzero(rank >= 0)
        if len(seen):
            begin[seen], stop[seen] = (self.pointer.get(rank[seen] + i).astype(np.int64) for i in (0, 1))
        out = np.full(len(context), -1, dtype=np.int64)
        there = np.flatnonzero(rank[which] >= 0)
        place = which[there]
        wanted = (rank[place].astype(np.uint64) << np.uint64(NEXT_BITS)) | short(word[there])
        out[there] = self.successor.find(wanted, begin[place], stop[place])
        return out

    def share(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """c(vw) / (c(v) + mu), as coded; 0 where the pair is not known."""
        at = self.place(context, word)
        return np.where(at >= 0, decode(self.code[at]), 0.0) if len(self.code) else np.zeros(len(at))


@lru_cache(maxsize=MAPPED)
def _pairs_level(folder: str, name: str) -> Pairs:
    return Pairs(mapped(folder, name))


class Triples:
    """The lowest level of one shard: for each entry of the pairs' list, pointers to its successors; codes as there.

    The last successor of a pair that has any is a mark whose code is the weight of the level above.
    """

    MARK = np.uint64((1 << NEXT_BITS) - 1)

    def __init__(self, data: np.ndarray):
        meta, arrays = unpack(data)
        lists = [EliasFano(m["n"], m["low_bits"], *arrays[3 * i : 3 * i + 3]) for i, m in enumerate(meta["lists"])]
        self.pointer, self.successor = lists
        self.code = arrays[6]

    @staticmethod
    def pack(pairs: int, place: np.ndarray, word: np.ndarray, share: np.ndarray, rest: np.ndarray) -> bytes:
        """``place`` and ``word`` are sorted together; ``rest`` is that of each distinct place."""
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]) + 1, len(place))
        place = np.insert(place, ends, place[ends - 1])
        word = np.insert(word, ends, Triples.MARK)
        code = np.insert(share, ends, rest)
        pointer = np.searchsorted(place, np.arange(pairs + 1)).astype(np.uint64)
        lists = [EliasFano.build(pointer, len(place) + 1), EliasFano.build((place.astype(np.uint64) << np.uint64(NEXT_BITS)) | word, pairs << NEXT_BITS)]
        parts = [x.parts() for x in lists]
        return pack({"lists": [p[0] for p in parts]}, [a for p in parts for a in p[1]] + [code])

    def share(self, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of a word after each pair, and the weight of the level above (1 for a pair without successors)."""
        begin, stop = (self.pointer.get(place + i).astype(np.int64) for i in (0, 1))
        there = np.flatnonzero(stop > begin)
        out, rest = np.zeros(len(place)), np.ones(len(place))
        begin, stop = begin[there], stop[there]
        at = self.successor.find((place[there].astype(np.uint64) << np.uint64(NEXT_BITS)) | short(word[there]), begin, stop - 1)
        out[there] = np.where(at >= 0, decode(self.code[at]), 0.0)
        rest[there] = decode(self.code[stop - 1])
        return out, rest


@lru_cache(maxsize=MAPPED)
def _triples_level(folder: str, name: str) -> Triples:
    return Triples(mapped(folder, name))


def short(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - NEXT_BITS)


def decode(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * code)


def _bits(context: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a pair in a table of ``size`` bits, a power of two."""
    key = mix(context * np.uint64(5) + word)
    return key & np.uint64(size - 1), (key >> np.uint64(32)) & np.uint64(size - 1)


def bit_table(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A table that holds these pairs (words of 40 bits), 16 bits or more for each."""
    size = 1 << max(6, (16 * len(context) - 1).bit_length())
    table = np.zeros(size, dtype=np.uint8)
    for at in _bits(context, word, size):
        table[at] = 1
    return np.packbits(table, bitorder="little")


def in_table(table: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    one, two = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in _bits(context, word, 8 * len(table)))
    return (one & two).astype(bool)


@lru_cache(maxsize=MAPPED)
def _often_table(folder: str, name: str) -> np.ndarray:
    return mapped(folder, name)


def lookup(folder: str, names: list[str], words: np.ndarray) -> np.ndarray:
    """Training counts of words."""
    out = np.zeros(len(words), dtype=np.int64)
    shard = shard_of_word(words, max(1, len(names)))
    for s, name in enumerate(names):
        mine = np.flatnonzero(shard == s)
        if name and len(mine):
            known, counts = _words_level(folder, name)
            at = known.find(words[mine])
            out[mine[at >= 0]] = counts[at[at >= 0]]
    return out


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words and the end of each row, and the offset of each row."""
    n = len(words.rows) - 1
    out = np.full(len(words.hashes) + n, END, dtype=np.uint64)
    out[np.arange(len(words.hashes)) + np.repeat(np.arange(n), words.counts)] = words.hashes
    return out, words.rows + np.arange(n + 1)


def contexts(all_tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty_like(all_tokens)
    out[1:] = all_tokens[:-1]
    out[rows[:-1]] = BEGIN
    return out


def shard_of_word(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words) % np.uint64(shards)).astype(np.int64)


def shard_of_pair(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(context * np.uint64(3) + word) % np.uint64(shards)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes, byte by byte: sorted numbers share their leading ones, which the shuffle's compression uses."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def _sum_by(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys (the first one leads) and their summed counts."""
    order = np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts, at) if len(at) else counts


PACKED = "shard long, n long, packed binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["shard", "n", "packed"])


def _count_words(text: str, shards: int, group: int = 8):
    """Packed counts of words, by shard, of a few blocks of text at a time."""

    def emit(words: list[np.ndarray]) -> pa.RecordBatch:
        distinct, times = np.unique(np.concatenate(words), return_counts=True)
        shard = shard_of_word(distinct, shards)
        parts = [(s, distinct[shard == s], times[shard == s]) for s in range(shards)]
        return _batch([(s, len(w), _planes(w, 8) + _planes(n, 4)) for s, w, n in parts if len(w)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, data, offsets in blocks(batches, text):
            held.append(tokens(Words(data, offsets, NOT_SPACE))[0])
            if len(held) == group:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def _count_pairs(text: str, shards: int, group: int = 8):
    """Packed counts of a word after a context, by shard, of a few blocks of text at a time."""

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every, context = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = shard_of_pair(context, every, shards).astype(np.uint32)
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(shards + 1))
        rows = []
        for s in range(shards):
            mine = by[bounds[s] : bounds[s + 1]]
            if len(mine):
                (c, w), times = _sum_by([context[mine], every[mine] >> np.uint64(64 - NEXT_BITS)], np.ones(len(mine), dtype=np.int64))
                rows.append((s, len(c), _planes(c, 8) + _planes(w, 5) + _planes(times, 4)))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, data, offsets in blocks(batches, text):
            every, rows = tokens(Words(data, offsets, NOT_SPACE))
            held.append((every, contexts(every, rows)))
            if len(held) == group:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def _count_triples(text: str, folder: str, often: list[str], group: int = 8):
    """Packed counts of a word after a pair, by the pair's shard, of triples whose two pairs are both in the tables."""
    shards = len(often)

    def frequent(every: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = shard_of_pair(context, every, shards).astype(np.uint32)
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(shards + 1))
        out = np.zeros(len(every), dtype=bool)
        for s, name in enumerate(often):
            mine = by[bounds[s] : bounds[s + 1]]
            if name and len(mine):
                out[mine] = in_table(_often_table(folder, name), context[mine], short(every[mine]))
        return out, shard

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        every, context = (np.concatenate(x) for x in zip(*held, strict=True))
        out, shard = frequent(every, context)
        last = np.flatnonzero(out[1:] & out[:-1] & (context[1:] != BEGIN)) + 1
        shard = shard[last - 1]
        by = last[np.argsort(shard, kind="stable")]
        bounds = np.searchsorted(np.sort(shard), np.arange(shards + 1))
        rows = []
        for s in range(shards):
            mine = by[bounds[s] : bounds[s + 1]]
            if len(mine):
                (u, v, w), times = _sum_by([context[mine - 1], short(context[mine]), short(every[mine])], np.ones(len(mine), dtype=np.int64))
                rows.append((s, len(u), _planes(u, 8) + _planes(v, 5) + _planes(w, 5) + _planes(times, 4)))
        return _batch(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, data, offsets in blocks(batches, text):
            every, rows = tokens(Words(data, offsets, NOT_SPACE))
            held.append((every, contexts(every, rows)))
            if len(held) == group:
                if (out := emit(held)) is not None:
                    yield out
                held = []
        if held and (out := emit(held)) is not None:
            yield out

    return run


def _write_words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        keys, counts = [], []
        for n, packed in zip(group["n"].to_pylist(), group["packed"].to_pylist(), strict=True):
            keys.append(_unplanes(memoryview(packed)[: 8 * n], n, 8))
            counts.append(_unplanes(memoryview(packed)[8 * n :], n, 4).astype(np.int64))
        (words,), total = _sum_by([np.concatenate(keys)], np.concatenate(counts))
        meta, arrays = EliasFano.build(words, 1 << 64).parts()
        name = put(folder, f"words-{group['shard'][0].as_py()}", pack(meta, [*arrays, total]))
        return pa.table({"shard": [group["shard"][0].as_py()], "name": [name], "often": [""], "n": [len(words)], "total": [int(total.sum())]})

    return run


def share_codes(times: np.ndarray, total: np.ndarray, mu: float) -> np.ndarray:
    """c(vw) / (c(v) + mu) in steps of log10, rounded down."""
    return np.ceil(np.log10((total + mu) / times) / STEP).astype(np.uint16)


def _write_pairs(folder: str, words: list[str], documents: int, mu: float):
    def run(group: pa.Table) -> pa.Table:
        context, word, counts = [], [], []
        for n, packed in zip(group["n"].to_pylist(), group["packed"].to_pylist(), strict=True):
            view = memoryview(packed)
            context.append(_unplanes(view[: 8 * n], n, 8))
            word.append(_unplanes(view[8 * n : 13 * n], n, 5))
            counts.append(_unplanes(view[13 * n :], n, 4).astype(np.int64))
        (c, w), times = _sum_by([np.concatenate(context), np.concatenate(word)], np.concatenate(counts))
        known, which = np.unique(c, return_inverse=True)
        total = np.where(known == BEGIN, documents, lookup(folder, words, known))[which]
        code = share_codes(times, total, mu)
        shard = group["shard"][0].as_py()
        name = put(folder, f"pairs-{shard}", Pairs.pack(c, w, code))
        twice = times >= 2
        often = put(folder, f"often-{shard}", bit_table(c[twice], w[twice]).tobytes()) if twice.any() else ""
        return pa.table({"shard": [shard], "name": [name], "often": [often], "n": [len(c)], "total": [int(times.sum())]})

    return run


def count_of(code: np.ndarray, total: np.ndarray, mu: float) -> np.ndarray:
    """The largest count with this code: the count itself up to about 430, at most 0.3 % more beyond."""
    return np.floor(10.0 ** (-STEP * (code.astype(float) - 1)) * (total + mu) * (1 - 1e-12))


def _write_triples(folder: str, words: list[str], pairs: list[str], documents: int, mu: float, nu: float):
    def run(group: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        for n, packed in zip(group["n"].to_pylist(), group["packed"].to_pylist(), strict=True):
            view, at = memoryview(packed), 0
            for column, width in zip(columns, (8, 5, 5, 4), strict=True):
                column.append(_unplanes(view[at : at + width * n], n, width))
                at += width * n
        (u, v, w), times = _sum_by([np.concatenate(c) for c in columns[:3]], np.concatenate(columns[3]).astype(np.int64))
        kept = times >= 2
        u, v, w, times = u[kept], v[kept], w[kept], times[kept]
        shard = group["shard"][0].as_py()
        if not len(u):
            return pa.table({"shard": [shard], "name": [""], "often": [""], "n": [0], "total": [0]})
        level = _pairs_level(folder, pairs[shard])
        begins = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        which = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(u))))
        place = level.place(u[begins], v[begins] << np.uint64(64 - NEXT_BITS))
        known, context = np.unique(u[begins], return_inverse=True)
        before = np.where(known == BEGIN, documents, lookup(folder, words, known))[context]
        total = count_of(level.code[place], before, mu) + nu
        rest = np.ceil(-np.log10(1 - np.add.reduceat(times, begins) / total) / STEP).astype(np.uint16)
        share = share_codes(times, total[which], 0.0)
        name = put(folder, f"triples-{shard}", Triples.pack(level.successor.n, place[which], w, share, rest))
        return pa.table({"shard": [shard], "name": [name], "often": [""], "n": [len(u)], "total": [int(times.sum())]})

    return run


FILES = "shard long, name string, often string, n long, total long"


class Model:
    """A trie in the shared folder: where its files are, and the totals of the training texts."""

    def __init__(self, folder: str, words: list[str], pairs: list[str], triples: list[str], tokens: int, types: int, documents: int, mu: float):
        self.folder, self.words, self.pairs, self.triples = folder, words, pairs, triples
        self.tokens, self.types, self.documents, self.mu = tokens, types, documents, mu

    def measure(self, every: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, log10 of the smoothed word probability, and of the model's probability."""
        distinct, which = np.unique(every, return_inverse=True)
        counts = lookup(self.folder, self.words, distinct)[which]
        plain = (counts + 1) / (self.tokens + self.types + 1)
        # the token before is a token of the same row, but for a row's first
        before = np.zeros_like(counts)
        before[1:] = counts[:-1]
        before[context == BEGIN] = self.documents
        share, third, rest = np.zeros(len(every)), np.zeros(len(every)), np.ones(len(every))
        shard = shard_of_pair(context, every, max(1, len(self.pairs))).astype(np.uint32)
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(len(self.pairs) + 1))
        for s, name in enumerate(self.pairs):
            mine = by[bounds[s] : bounds[s + 1]]
            if name and len(mine):
                level = _pairs_level(self.folder, name)
                at = level.place(context[mine], every[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                share[mine] = decode(level.code[at])
                if self.triples[s]:
                    # the pair is the context of the token after it, in the same row
                    more = mine + 1 < len(every)
                    more[more] = context[mine[more] + 1] != BEGIN
                    after = mine[more] + 1
                    third[after], rest[after] = _triples_level(self.folder, self.triples[s]).share(at[more], every[after])
        return counts, np.log10(plain), np.log10(third + rest * (share + self.mu / (before + self.mu) * plain))


def train(docs: DataFrame, text: str = "text", mu: float = MU, nu: float = NU, shard_bytes: int = 24 << 20) -> Model:
    """Count ``docs`` and write the trie; the driver keeps the list of files, three for each ``shard_bytes`` of text."""
    spark = docs.sparkSession
    folder = fresh(spark, "ngrams")
    size, documents = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    pair_shards = max(1, -(-(size or 0) // shard_bytes))
    word_shards = max(1, pair_shards // 8)

    def files(count, write) -> list:
        packed = docs.select(text).mapInArrow(count, PACKED)
        return written(packed.groupBy("shard").applyInArrow(write, FILES), "files").collect()

    words, total, types = [""] * word_shards, 0, 0
    for row in files(_count_words(text, word_shards), _write_words(folder)):
        words[row["shard"]], total, types = row["name"], total + row["total"], types + row["n"]
    pairs, often, triples = ([""] * pair_shards for _ in range(3))
    for row in files(_count_pairs(text, pair_shards), _write_pairs(folder, words, documents, mu)):
        pairs[row["shard"]], often[row["shard"]] = row["name"], row["often"]
    if any(often):
        for row in files(_count_triples(text, folder, often), _write_triples(folder, words, pairs, documents, mu, nu)):
            triples[row["shard"]] = row["name"]
    return Model(folder, words, pairs, triples, total, types, documents, mu)


#: Bytes of text that are scored together.
SCORED = 8 << 20

SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text, SCORED):
            every, rows = tokens(Words(data, offsets, NOT_SPACE))
            context, row = contexts(every, rows), np.repeat(np.arange(batch.num_rows), np.diff(rows))
            sums = [np.zeros(batch.num_rows, dtype=kind) for kind in (np.int64, float, float)]
            for at in range(0, len(every), SLICE):
                # with the token before, whose count the first one's context needs
                cut, drop = slice(max(0, at - 1), at + SLICE), min(at, 1)
                counts, plain, full = (x[drop:] for x in model.measure(every[cut], context[cut]))
                for total, x in zip(sums, (counts > 0, plain, full), strict=True):
                    total += np.bincount(row[at : at + SLICE], weights=x, minlength=batch.num_rows).astype(total.dtype)
            values = [np.diff(rows).astype(np.int64), sums[0], np.full(batch.num_rows, model.tokens), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values)], names=[id_col, *(c.split()[0] for c in SCORES.split(", "))])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCORES}")
