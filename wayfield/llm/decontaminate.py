"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of an item, or a whole shorter item. Of the k-gram hashes (k = 6) the smallest of every 8
consecutive ones is kept, so any shared run of 13 words shares a kept fingerprint (6 + 8 - 1 = 13). Fingerprints of
documents and items are joined; each hit is extended to the windows around it, and these are joined to the items' windows.
A shorter item is its own fingerprint: documents are cut at that length too (at most twelve lengths).

Documents' fingerprints are first tested against a bit table of the items' fingerprints, of fixed size (512 KB). It has no
false negatives; the more items there are, the less it filters, and the join, which is not broadcast unless Spark finds
the table small, does the rest.

Words are runs of ASCII letters, digits and code points above 127, with A-Z lower-cased. Null and empty texts have none.
Rows are told apart by id and text: repeated rows get equal results. An item without an id marks words but is not listed;
repeated items count once. An empty benchmark finds nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfield.llm.store import written
from wayfield.llm.text import ALPHANUMERIC, Words, blocks, grams, mix

WINDOW, GRAM = 13, 6
TABLE_BITS = 22


def winnow(hashes: np.ndarray, at: np.ndarray, rows_of: np.ndarray, window: int) -> np.ndarray:
    """Indices of the k-grams kept: the smallest (the rightmost, if several) of every ``window`` in a row."""
    size = len(hashes) - window + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64)
    least, where = hashes[:size].copy(), np.arange(size)
    for j in range(1, window):
        lower = hashes[j : j + size] <= least
        least[lower] = hashes[j : j + size][lower]
        where[lower] = np.flatnonzero(lower) + j
    inside = rows_of[:size] == rows_of[window - 1 :]
    return np.unique(where[inside])


def _fingerprints(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the index of their first word."""
    hashes, at = grams(words.hashes, words.rows, gram)
    rows_of = np.searchsorted(words.rows, at, side="right")
    kept = winnow(hashes, at, rows_of, window - gram + 1)
    return mix(hashes[kept] + np.uint64(1)), at[kept]


def _items(id_col: str, text: str, gram: int, window: int):
    """Per item: its windows' hashes, their length, and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            words = Words(data, offsets, ALPHANUMERIC)
            ids = batch.column(batch.schema.get_field_index(id_col))
            full, at = grams(words.hashes, words.rows, window)
            prints, where = _fingerprints(words, gram, window)
            kinds = [(full, at, window, "window"), (prints, where, window, "print")]
            for length in range(1, window):
                hashes, first = grams(words.hashes, words.rows, length)
                row = np.searchsorted(words.rows, first, side="right") - 1
                whole = words.counts[row] == length
                kinds += [(hashes[whole], first[whole], length, kind) for kind in ("window", "print")]
            for hashes, first, length, kind in kinds:
                if len(hashes):
                    row = np.searchsorted(words.rows, first, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), length)), pa.array([kind] * len(hashes))],
                        names=["item_id", "hash", "length", "kind"],
                    )

    return run


def _hits(id_col: str, text: str, gram: int, window: int, bits: np.ndarray, lengths: list[int]):
    shift = np.uint64(64 - TABLE_BITS)

    def known(hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> shift).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            words = Words(data, offsets, ALPHANUMERIC)
            found: list[tuple[np.ndarray, ...]] = []  # first word of the window, its hash and length, the fingerprint
            if window in lengths:
                prints, at = _fingerprints(words, gram, window)
                near = known(prints)
                prints, at = prints[near], at[near]
                full, first = grams(words.hashes, words.rows, window)
                for back in range(window - gram + 1):
                    start = at - back
                    place = np.searchsorted(first, start)
                    inside = (place < len(first)) & (start >= 0)
                    inside[inside] &= first[place[inside]] == start[inside]
                    found.append((start[inside], full[place[inside]], np.full(inside.sum(), window), prints[inside]))
            for length in lengths:
                if length < window:
                    hashes, first = grams(words.hashes, words.rows, length)
                    near = known(hashes)
                    found.append((first[near], hashes[near], np.full(near.sum(), length), hashes[near]))
            start, hashes, length, prints = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.int64)] * 4
            row = np.searchsorted(words.rows, start, side="right") - 1
            order = np.argsort(row, kind="stable")
            start, hashes, length, prints, row = (x[order] for x in (start, hashes, length, prints, row))
            each = pa.StructArray.from_arrays(
                [pa.array(prints.astype(np.uint64).view(np.int64)), pa.array(hashes.astype(np.uint64).view(np.int64)), pa.array(start - words.rows[row]), pa.array(length.astype(np.int64))],
                names=["print", "hash", "start", "length"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)),
                    batch.column(batch.schema.get_field_index("text_key")),
                    pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), type=pa.int32()), each),
                ],
                names=["id", "text_key", "n_words", "hits"],
            )

    return run


def benchmark_index(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The items' windows and fingerprints, written once: item_id, hash, length, kind."""
    schema = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("hash", T.LongType()), T.StructField("length", T.LongType()), T.StructField("kind", T.StringType())])
    return written(items.select(id_col, text).mapInArrow(_items(id_col, text, gram, window), schema), "benchmark")


def _bit_table(index: DataFrame) -> np.ndarray:
    """A bit for each value of the leading bits of the items' fingerprints: 2^22 bits, whatever the number of items."""
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    slots = index.filter("kind = 'print'").select(slot.alias("slot"))
    lines = slots.groupBy(F.shiftright("slot", 6).alias("line")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    for line, bits in lines.toLocalIterator():
        out[line] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out.view(np.uint8)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, text_key, n_words, n_hit, item_ids (sorted as strings), spans (start, length) of hit windows."""
    index = benchmark_index(items, window=window, gram=gram)
    lengths = sorted(r[0] for r in index.select("length").distinct().collect())
    kind = docs.schema[id_col].dataType
    hit = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("print", "hash", "start", "length")]))
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", hit)])
    base = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text")).mapInArrow(_hits("id", "text", gram, window, _bit_table(index), lengths), schema), "prints")
    prints = index.filter("kind = 'print'").select(F.col("hash").alias("print"), "length").distinct()
    windows = index.filter("kind = 'window'").select("hash", "length", "item_id").distinct()
    near = base.filter("size(hits) > 0").select("id", "text_key", F.inline("hits")).join(prints, ["print", "length"], "left_semi")
    spans = near.select("id", "text_key", "hash", "start", "length").distinct().join(windows, ["hash", "length"])
    per = spans.groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    cover = """aggregate(spans, named_struct('covered', 0L, 'reach', 0L), (a, x) -> named_struct(
        'covered', a.covered + greatest(0L, x.start + x.length - greatest(a.reach, x.start)), 'reach', greatest(a.reach, x.start + x.length)), a -> a.covered)"""
    per = per.withColumn("n_hit", F.expr(cover)).withColumnRenamed("id", "pid").withColumnRenamed("text_key", "pkey")
    joined = base.drop("hits").join(per, F.expr("id <=> pid and text_key = pkey"), "left")
    return joined.selectExpr(
        f"id `{id_col}`", "text_key", "n_words", "coalesce(n_hit, 0L) n_hit", "coalesce(item_ids, array()) item_ids", "coalesce(spans, array()) spans"
    )
