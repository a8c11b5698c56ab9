"""Repeated passages: runs of sentences and of words hashed, joined over all documents, and removed where they are not the first.

A sentence ends after ``.``, ``!``, ``?`` or a line break (with any closing marks and white space after it). From the
``longest``-th word after the last end on, it is also cut before the word of the smallest hash of every few words: a cut
depends on the words around it and on the ``longest`` words before it only, never on how long the sentence is in its
document, and runs of one word are cut too (before each). A span is the shortest run of at least ``span`` sentences from a sentence on that has ``least``
words, or one sentence of ``alone`` words: common short lines are left alone, shouted one-word sentences are runs too.
Spans are compared by their words (A-Z lower-cased), not by white space.

Passages that do not keep to sentences are found by winnowing: of the hashes of all runs of ``least`` words, the smallest of
every ``alone - least + 1`` in a row is a span as well, so any two equal runs of ``alone`` words share one, wherever they stand.

Of equal spans the one in the smallest document, and there the earliest, is first and stays; every other one is extended
word by word to both sides for as long as the words are those around the first one (spans that continue each other are
joined before), and all its words are cut out of the text. An equal run of ``alone`` words reaches at most
``alone - least`` words beyond its outermost spans; ``longest`` words are compared to each side. What is cut therefore has
an equal run, word for word, at an earlier place.

Spans of one hash are counted before the shuffle and joined by Spark's skew join, and so are the words around first
places, so a passage of a third of all documents is no group of one task; a document's own runs are all that a row
gathers. Where a document repeats itself at a short distance, only the outermost spans are extended.

Null texts stay null; empty texts, and texts whose spans are all short, stay as they are. Rows without an id come last in
the order. Rows that repeat an id and text are one document. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from wayfield.llm.decontaminate import winnow
from wayfield.llm.store import written
from wayfield.llm.text import NOT_SPACE, Words, blocks, grams, mix

SPAN, LEAST, ALONE, LONGEST = 2, 24, 40, 48
#: Columns that are added; columns of ``docs`` with these names are replaced.
NEW = ("n_sentences", "n_removed", "chars_removed")
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, words: Words, longest: int = LONGEST) -> np.ndarray:
    """Index of each sentence's first word."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.zeros(n, dtype=bool)
    first[words.rows[:-1][words.counts > 0]] = True
    # an end mark among the last two bytes of a word: "word." or 'word."'
    ended = _STOP[data[words.ends - 1]] | (_STOP[data[np.maximum(words.ends - 2, words.starts)]] & (words.ends - words.starts > 1))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    first[1:] |= ended[:-1] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, n))
    if (size > longest).any():
        deep = np.arange(n) - np.repeat(starts, size) >= longest
        row = np.repeat(np.arange(len(words.counts)), words.counts)
        cut = winnow(words.hashes, None, row, max(1, longest // 6 - 1))
        first[cut[deep[cut]]] = True
        starts = np.flatnonzero(first)
    return starts


def spans(words: Words, starts: np.ndarray, span: int, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of every span."""
    n = len(words.hashes)
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    size = np.diff(np.append(starts, n))
    row = np.searchsorted(words.rows, starts, side="right") - 1
    at = np.arange(n) - np.repeat(starts, size)
    odd = mix(np.arange(int(size.max()), dtype=np.uint64) + np.uint64(1))[at] | np.uint64(1)
    own = mix(np.add.reduceat(words.hashes * odd, starts) + size.astype(np.uint64))
    total, count, length = np.zeros(len(starts), dtype=np.uint64), size * 0, size * 0
    growing = np.ones(len(starts), dtype=bool)
    for j in range(max(span, least, alone)):
        if not growing.any():
            break
        to = np.arange(len(starts)) + j
        growing &= to < len(starts)
        growing[growing] &= row[to[growing]] == row[growing]
        growing &= (length < alone) & ((length < least) | (count < span))
        total[growing] = mix(total[growing] * np.uint64(3) + own[to[growing]])
        length[growing] += size[to[growing]]
        count[growing] += 1
    good = (length >= alone) | ((length >= least) & (count >= span))
    return np.flatnonzero(good), count[good], total[good]


def runs(words: Words, starts: np.ndarray, span: int, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and hash of every span of sentences and every winnowed run of ``least`` words, by row."""
    first, count, hashes = spans(words, starts, span, least, alone)
    ends = np.append(starts, len(words.hashes))
    inside, at = grams(words.hashes, words.rows, least)
    kept = winnow(inside, None, np.searchsorted(words.rows, at, side="right"), max(1, alone - least + 1))
    begin = np.concatenate([starts[first], at[kept]])
    size = np.concatenate([ends[first + count] - starts[first], np.full(len(kept), least)])
    order = np.argsort(begin, kind="stable")
    return begin[order], size[order], np.concatenate([hashes, mix(inside[kept] + np.uint64(1))])[order]


def _spans(text: str, span: int, least: int, alone: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            words = Words(data, offsets, NOT_SPACE)
            begin, size, hashes = runs(words, sentences(data, words), span, least, alone)
            row = np.searchsorted(words.rows, begin, side="right") - 1
            each = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array((begin - words.rows[row]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["hash", "at", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), type=pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "text_key", "spans"])

    return run


def _around(text: str, reach: int):
    """For each place (a word, and a side) of a document: 32 bits of the hashes of the words on that side, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            words = Words(data, offsets, NOT_SPACE)
            low = words.hashes.astype(np.uint32).view(np.int32)
            row, pos, side, near = [], [], [], []
            for i, places in enumerate(batch.column(batch.schema.get_field_index("places")).to_pylist()):
                own = low[words.rows[i] : words.rows[i + 1]]
                for place in places:
                    p, right = place["pos"], place["side"]
                    row.append(i)
                    pos.append(p)
                    side.append(right)
                    near.append(own[p : p + reach] if right else own[max(0, p - reach) : p][::-1])
            ends = np.cumsum([0, *map(len, near)])
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate([*near, low[:0]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(row, type=pa.int64())) for c in (0, 1)] + [pa.array(pos, type=pa.int32()), pa.array(side, type=pa.int32()), lists], names=["first_id", "first_key", "pos", "side", "near"]
            )

    return run


def _covered(own: np.ndarray, cut: list[dict]) -> np.ndarray:
    """Which words of a document its repeats cover, each extended to its side."""
    change = np.zeros(len(own) + 1, dtype=np.int64)
    for x in cut:
        begin, end = x["begin"], x["end"]
        if x["near"]:
            near = np.array(x["near"], dtype=np.int32)
            mine = own[end : end + len(near)] if x["side"] else own[max(0, begin - len(near)) : begin][::-1]
            differ = np.flatnonzero(mine != near[: len(mine)])
            more = int(differ[0]) if len(differ) else len(mine)
            begin, end = (begin, end + more) if x["side"] else (begin - more, end)
        change[begin] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def _cut(text: str, at: str, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            words = Words(data, offsets, NOT_SPACE)
            starts = sentences(data, words)
            of_row = np.searchsorted(starts, words.rows)
            low = words.hashes.astype(np.uint32).view(np.int32)
            cuts = batch.column(batch.schema.get_field_index(at)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            total, removed, chars = np.diff(of_row), [], []
            for i, cut in enumerate(cuts):
                removed.append(0)
                chars.append(0)
                if not cut:
                    continue
                a, b = words.rows[i], words.rows[i + 1]
                gone = _covered(low[a:b], cut)
                removed[-1] = int(np.logical_or.reduceat(gone, starts[of_row[i] : of_row[i + 1]] - a).sum())
                # a word takes the white space after it along
                begin = np.append(words.starts[a:b], offsets[i + 1])
                begin[0] = offsets[i]
                kept = data[offsets[i] : offsets[i + 1]][~np.repeat(gone, np.diff(begin))].tobytes()
                whole, texts[i] = texts[i], kept.decode("utf-8", "replace")
                chars[-1] = len(whole) - len(texts[i])
            values = {text: pa.array(texts, type=pa.string()), "n_sentences": pa.array(total.astype(np.int64)), "n_removed": pa.array(removed, type=pa.int64()), "chars_removed": pa.array(chars, type=pa.int64())}
            yield pa.RecordBatch.from_arrays([values.get(c, batch.column(batch.schema.get_field_index(c)) if c in batch.schema.names else None) for c in schema_names], names=schema_names)

    return run


def text_key(text: str) -> Column:
    """A hash of the text that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST, alone: int = ALONE, reach: int = LONGEST) -> DataFrame:
    """id, text_key, cut: runs of words (begin, end) equal to an earlier place's, and the words around that place on one side."""
    kind = docs.schema[id_col].dataType
    each = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_key", T.LongType()), T.StructField("spans", each)])
    texts = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    found = written(texts.mapInArrow(_spans("text", span, least, alone), schema), "spans")
    rows = found.select("id", "text_key", F.inline("spans"))
    # the first place of a hash: ids in order, a missing id last, then the text's key and the word
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "at")
    repeated = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("hash")
    # both sides of a join are tables of their own: Spark splits a hot key only where no aggregate sits below the join
    repeated = written(rows.join(written(repeated, "hashes"), "hash"), "repeated")
    firsts = written(repeated.groupBy("hash").agg(F.min(place).alias("first")), "firsts")
    later = repeated.join(firsts, "hash").filter(place != F.col("first"))
    later = later.groupBy("id", "text_key", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"), (F.col("at") - F.col("first.at")).alias("shift"), "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    # spans at one distance from their first places that meet or overlap are one run
    doc = ["id", "text_key", "first_id", "first_key"]
    order = Window.partitionBy(*doc, "shift").orderBy("at")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = later.repartition("id", "text_key").withColumn("new", F.when(before >= F.col("at"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    joined = joined.groupBy(*doc, "shift", "run").agg(F.min("at").alias("begin"), F.max("end").alias("end"))
    joined = joined.select(*doc, "begin", "end", (F.col("begin") - F.col("shift")).alias("left"), (F.col("end") - F.col("shift")).alias("right"))
    # of overlapping runs with one border at the first place (a text that repeats itself), the outermost are extended
    sooner = F.max("end").over(Window.partitionBy(*doc, "left").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("begin").over(Window.partitionBy(*doc, "right").orderBy("end", "begin").rowsBetween(1, Window.unboundedFollowing))
    outer = joined.select("*", (F.coalesce(sooner, F.lit(-1)) < F.col("begin")).alias("to_left"), F.coalesce(after > F.col("end"), F.lit(True)).alias("to_right"))
    side = F.array(
        F.when(F.col("to_left") & (F.col("begin") > 0) & (F.col("left") > 0), F.struct(F.lit(0).alias("side"), F.col("left").alias("pos"))),
        F.when(F.col("to_right"), F.struct(F.lit(1).alias("side"), F.col("right").alias("pos"))),
    )
    sides = F.expr("filter(sides, x -> x is not null)")
    edges = written(outer.withColumn("sides", side).withColumn("sides", sides).select(*doc, "begin", "end", F.inline_outer("sides")), "edges")
    # the words around the first places, once for each place
    wanted = edges.filter("side is not null").groupBy("first_id", "first_key").agg(F.collect_set(F.struct("pos", "side")).alias("places"))
    wanted = written(wanted, "places").hint("merge")
    once = texts.join(wanted, F.expr("id <=> first_id and text_key = first_key")).select("id", "text_key", "text", "places")
    names = T.StructType([T.StructField("first_id", kind), T.StructField("first_key", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("near", T.ArrayType(T.IntegerType()))])
    near = written(once.mapInArrow(_around("text", reach), names).dropDuplicates(["first_id", "first_key", "pos", "side"]), "around")
    ends = edges.alias("e").join(near.hint("merge").alias("w"), F.expr("e.first_id <=> w.first_id and e.first_key = w.first_key and e.pos = w.pos and e.side = w.side"), "left")
    ends = ends.select("e.id", "e.text_key", F.struct("e.begin", "e.end", "e.side", "w.near").alias("x"))
    return ends.groupBy("id", "text_key").agg(F.collect_list("x").alias("cut"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, least: int = LEAST, alone: int = ALONE) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and n_sentences, n_removed (those that lose words), chars_removed."""
    docs = docs.drop(*(c for c in NEW if c not in (id_col, text)))
    cuts = written(repeated_runs(docs, id_col, text, span, least, alone), "cuts")
    joined = docs.select(F.struct("*").alias("d")).join(cuts.hint("merge").alias("c"), F.expr(f"d.`{id_col}` <=> c.id and xxhash64(coalesce(d.`{text}`, '')) = c.text_key"), "left").select("d.*", F.col("c.cut").alias("cut_of_row"))
    new = [T.StructField(c, T.LongType()) for c in NEW]
    schema = T.StructType([*docs.schema.fields, *new])
    return joined.mapInArrow(_cut(text, "cut_of_row", schema.names), schema)
