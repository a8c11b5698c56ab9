"""Fill-in-middle texts: a text is cut at two token boundaries into prefix, middle and suffix, and written in another order.

Tokens are runs of ASCII letters, and every other code point alone. A learned rank index holds the byte offset of every
boundary of a block of texts: straight segments from rank to offset, each within ``BOUND`` of all boundaries that it covers
(a segment that is not is halved), and the residual of every boundary in one byte. A cut is the segment's prediction at
its rank, corrected by the stored residual, which is exact. Boundaries are found and fitted in pieces of 1 MB, so a long
text needs a byte for each token beside its own bytes.

The draws are the first four 8-digit groups h1 to h4 of the hexadecimal SHA-256 of ``seed:id``. With n tokens the prefix ends
after the smaller of h1 % (n + 1) and h2 % (n + 1) tokens, the middle after the larger. A text is left plain if it is empty,
holds one of the three marks, or h3 % 100 >= ``percent``; of the others those with h4 % 100 < ``spm_percent`` are written suffix first.

Null texts are empty; a null id is the empty text. Repeated rows get equal results. An empty table gives no row. Further
columns are ignored. Every row of the input is a row of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from wayfield.llm.text import blocks

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"

BOUND = 127
SPAN = 1 << 12
PIECE = 1 << 20

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes that go on inside a code point.
WITHIN = np.zeros(256, dtype=bool)
WITHIN[0x80:0xC0] = True


class RankIndex:
    """The offset of each boundary by its rank; offsets are added in rising order."""

    def __init__(self) -> None:
        self.size = 0
        self._ranks: list[np.ndarray] = []
        self._bases: list[np.ndarray] = []
        self._slopes: list[np.ndarray] = []
        self._residuals: list[np.ndarray] = []

    def add(self, offsets: np.ndarray) -> None:
        """Fit segments to the next offsets: lines through a span's ends, halved until no boundary is further off than the bound."""
        count = len(offsets)
        if not count:
            return
        residuals = np.zeros(count, dtype=np.int8)
        starts = np.arange(0, count, SPAN)
        ends = np.append(starts[1:], count)
        fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(starts):
            lengths = ends - starts
            slopes = (offsets[ends - 1] - offsets[starts]) / np.maximum(lengths - 1, 1)
            first = np.cumsum(lengths) - lengths
            step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            at = np.repeat(starts, lengths) + step
            off = offsets[at] - np.repeat(offsets[starts], lengths) - np.floor(np.repeat(slopes, lengths) * step).astype(np.int64)
            good = np.maximum.reduceat(np.abs(off), first) <= BOUND
            fitted.append((starts[good], offsets[starts[good]], slopes[good]))
            fits = np.repeat(good, lengths)
            residuals[at[fits]] = off[fits]
            starts, ends = starts[~good], ends[~good]
            middle = (starts + ends) // 2
            starts, ends = np.concatenate([starts, middle]), np.concatenate([middle, ends])
        ranks, bases, slopes = (np.concatenate(x) for x in zip(*fitted, strict=True))
        order = np.argsort(ranks)
        self._ranks.append(ranks[order] + self.size)
        self._bases.append(bases[order])
        self._slopes.append(slopes[order])
        self._residuals.append(residuals)
        self.size += count

    def close(self) -> RankIndex:
        self.ranks, self.bases, self.slopes, self.residuals = (np.concatenate(x) for x in (self._ranks, self._bases, self._slopes, self._residuals))
        return self

    def __getitem__(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.ranks, rank, side="right") - 1
        guess = np.floor(self.slopes[segment] * (rank - self.ranks[segment])).astype(np.int64)
        return self.bases[segment] + guess + self.residuals[rank]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[RankIndex, np.ndarray]:
    """The index over the first bytes of all tokens of a block, and the rank of the first boundary at or after each offset."""
    index, ranks = RankIndex(), np.zeros(len(offsets), dtype=np.int64)
    for begin in range(0, len(data), PIECE):
        piece = data[max(begin - 1, 0) : begin + PIECE]
        letter = LETTER[piece]
        new = ~WITHIN[piece]
        new[1:] &= ~(letter[1:] & letter[:-1])
        if begin:
            new = new[1:]
        end = begin + len(new)
        texts = np.flatnonzero((offsets >= begin) & (offsets < end))
        new[offsets[texts] - begin] = True
        found = np.flatnonzero(new) + begin
        ranks[texts] = index.size + np.searchsorted(found, offsets[texts])
        index.add(found)
    ranks[offsets == len(data)] = index.size
    index.add(np.array([len(data)]))
    return index.close(), ranks


def _points(data: np.ndarray) -> int:
    return sum(len(x) - int(np.count_nonzero(WITHIN[x])) for x in (data[i : i + PIECE] for i in range(0, len(data), PIECE)))


def _write(percent: int, spm_percent: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            index, ranks = boundaries(data, offsets)
            n = np.diff(ranks)
            h1, h2, h3, h4 = (rows.column(i).to_numpy() for i in range(2, 6))
            cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            first, second = (index[ranks[:-1] + c] for c in cuts)
            marked = pc.match_substring_regex(pc.fill_null(rows.column(1), ""), MARK).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h3 % 100 >= percent)
            form = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm"))
            outputs, sizes = [], []
            for i, kind in enumerate(form):
                whole = data[offsets[i] : offsets[i + 1]]
                p, m = first[i] - offsets[i], second[i] - offsets[i]
                if kind == "plain":
                    outputs.append(whole.tobytes())
                    sizes.append((None, None))
                    continue
                prefix, middle, suffix = whole[:p], whole[p:m], whole[m:]
                parts = (marks[0], prefix, marks[1], suffix) if kind == "psm" else (marks[1], suffix, marks[0], prefix)
                outputs.append(b"".join([*(x if isinstance(x, bytes) else x.tobytes() for x in parts), marks[2], middle.tobytes()]))
                sizes.append((_points(prefix), _points(middle)))
            texts = pa.array(outputs, type=pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(form, type=pa.string()), texts, *(pa.array([s[k] for s in sizes], type=pa.int64()) for k in (0, 1))],
                names=[rows.schema.names[0], "n", "form", "output", "prefix_chars", "middle_chars"],
            )

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """id, n (tokens), form (plain, psm or spm), output, prefix_chars and middle_chars (code points; null if plain)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"), *draws)
    return rows.mapInArrow(_write(percent, spm_percent), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, form string, output string, prefix_chars long, middle_chars long")


def _cut(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and after it."""
    head = F.substring_index(text, mark, 1)
    return head, F.substr(text, F.length(head) + F.lit(1 + len(mark)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, cut at the first mark of each kind; no text that is cut holds a mark."""
    body = F.substr(output, F.lit(1 + len(PREFIX)))
    prefix, rest = _cut(body, SUFFIX)
    suffix, middle = _cut(rest, MIDDLE)
    suffix2, rest2 = _cut(body, PREFIX)
    prefix2, middle2 = _cut(rest2, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
