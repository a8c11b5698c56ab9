"""Near-duplicates by b-bit MinHash: bands propose, packed low bits prune, whole shingle sets decide.

1. One pass gives each document its number of distinct shingles, a 128-bit digest of the set, band keys made of full
   minima, and the packed low two bits of all minima.
2. Documents with equal sets form a class; only one document of a class goes on, so copies cost one row each.
3. Band buckets of two or more classes are kept. Every bucket is first compared with one pivot, the member that meets
   most others over all bands (the original among its near copies), so a group of any size costs one comparison a member.
4. Links join components; only members of one bucket that are still in different components are then compared with each
   other. Before sets are compared, the bit count of the xor of the packed minima gives a similarity corrected for chance
   equality; only pairs more than 5.5 standard deviations under the threshold are dropped.
5. Each remaining pair is decided on the two full sets. Copies and pairs that are no links never become rows.

32 bands of 4 minima miss a pair at similarity 0.75 with probability 5e-6, and less above. There is no cap on buckets.

Null and empty texts, and texts without words, have no set and link with nothing. Texts of fewer than five words are one
shingle. Rows that share an id but not their text are linked through it. Rows without an id belong to their class but never name it; a class of
such rows only has a null component and all its rows are kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from wayfield.llm.store import written
from wayfield.llm.text import NOT_SPACE, Words, blocks, grams, list_of, mix

BANDS, ROWS, LOW_BITS = 32, 4, 2
SLACK = 5.5
#: Minima of the wider signature, made for the few documents that are still open after the first comparisons.
WIDE = 512
BITS = ["bits0", "bits1", "bits2", "bits3"]


def _shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their offsets by row; a row with fewer than ``n`` words is one shingle."""
    hashes, at = grams(words.hashes, words.rows, n)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [grams(words.hashes[a:b], np.array([0, b - a]), b - a)[0] for a, b in zip(words.rows[short], words.rows[short + 1], strict=True)]
        hashes, at = np.concatenate([hashes, *whole]), np.concatenate([at, words.rows[short]])
        order = np.argsort(at, kind="stable")
        hashes, at = hashes[order], at[order]
    return hashes, np.searchsorted(at, words.rows)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted, without repeats."""
    if not len(hashes):
        return hashes, offsets
    out = np.empty_like(hashes)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out[a:b] = np.sort(hashes[a:b])
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def _minima(sets: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k minima for each row that has a set, as rows x k."""
    draw = np.random.default_rng(seed).integers(0, 1 << 63, size=(2, k), dtype=np.uint64)
    out = np.empty((k, len(offsets) - 1), dtype=np.uint64)
    x = np.empty_like(sets)
    for i in range(k):
        np.bitwise_xor(sets, draw[0, i], out=x)
        np.multiply(x, draw[1, i] * np.uint64(2) + np.uint64(1), out=x)
        out[i] = np.minimum.reduceat(x, offsets[:-1])
    return out.T


def _sign(id_col: str, text: str, n: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, text):
            sets, at = _distinct(*_shingles(Words(data, offsets, NOT_SPACE), n))
            counts = np.diff(at)
            full = counts > 0
            total = np.zeros((2, len(counts)), dtype=np.uint64)
            keys, packed = np.zeros((0, bands), dtype=np.uint64), np.zeros((len(counts), 4), dtype=np.uint64)
            if len(sets):
                begins = at[:-1][full]
                for i, salt in enumerate((0x51, 0xA7)):
                    total[i, full] = np.add.reduceat(mix(sets ^ np.uint64(salt)), begins)
                minima = _minima(sets, np.append(begins, len(sets)), bands * rows, seed)
                keys = np.zeros((len(begins), bands), dtype=np.uint64)
                for b in range(bands):
                    key = np.full(len(begins), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + minima[:, b * rows + r])
                    keys[:, b] = key
                low = mix(minima) & np.uint64(3)
                each = bands * rows // 4
                for w in range(4):
                    packed[full, w] = (low[:, w * each : (w + 1) * each] << (np.uint64(2) * np.arange(each, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts),
                    *(pa.array(t.view(np.int64)) for t in total),
                    *(pa.array(np.ascontiguousarray(packed[:, w]).view(np.int64)) for w in range(4)),
                    list_of(keys.reshape(-1), np.concatenate([[0], np.cumsum(full * bands)])),
                ],
                names=["id", "text_key", "n_shingles", "set_a", "set_b", *BITS, "bands"],
            )

    return run


def _sets(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            sets, at = _distinct(*_shingles(Words(data, offsets, NOT_SPACE), n))
            keep = np.flatnonzero(np.diff(at) > 0)
            if not len(keep):
                continue
            low = mix(_minima(sets, np.append(at[:-1][keep], len(sets)), WIDE, seed)) & np.uint64(3)
            packed = (low.reshape(len(keep), -1, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    list_of(sets, np.append(at[:-1][keep], len(sets))),
                    list_of(packed.reshape(-1), np.arange(len(keep) + 1) * packed.shape[1]),
                ],
                names=["id", "shingles", "wide"],
            )

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """id, n_shingles, set_a and set_b (digest of the set), bits0..3 (packed low bits), bands (a key for each)."""
    if bands * rows != 128:
        raise ValueError("bands x rows must be 128: the low bits fill four longs")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ["text_key", "n_shingles", "set_a", "set_b", *BITS]), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text, _text_key(text).alias("text_key_")).mapInArrow(_sign(id_col, text, n, bands, rows, seed), schema)


def close_enough(similarity: float, k: int, parts: list[str]) -> str:
    """SQL: the packed two-bit minima of rows l and r do not rule the similarity out."""
    pair = lambda p: f"l.{p} ^ r.{p}"
    odd = "6148914691236517205L"  # 0x5555...
    unequal = " + ".join(f"bit_count((({pair(p)}) | shiftrightunsigned({pair(p)}, 1)) & {odd})" for p in parts)
    return f"{unequal} <= {k - least_matches(similarity, k)}"


def least_matches(similarity: float, k: int = BANDS * ROWS, slack: float = SLACK) -> int:
    """Fewer equal minima than this are not met, but by chance, at this similarity: chance equality is 1/4 with two bits."""
    p = similarity + (1 - similarity) / (1 << LOW_BITS)
    return int(np.floor(k * p - slack * np.sqrt(k * p * (1 - p))))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in links (a, b), by alternating large and small stars."""
    pairs = written(links.selectExpr("greatest(a, b) u", "least(a, b) v").filter("u <> v").distinct(), "links")
    while True:
        both = pairs.unionByName(pairs.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").selectExpr("v u", "m v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").filter("v <> m").selectExpr("v u", "m v").unionByName(first.selectExpr("u", "m v")).distinct()
        after = written(small, "stars")
        digest = [t.selectExpr("count(*) n", "sum(cast(hash(u, v) as long)) s", "sum(cast(hash(v, u, 1) as long)) t").first() for t in (pairs, after)]
        if digest[0] == digest[1]:
            break
        pairs = after
    return pairs.selectExpr("u id", "v component").unionByName(pairs.selectExpr("v id", "v component").distinct())


def _full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """id (of the class), shingles and a wider signature, from one document of each of the ``classes`` (id, rep, text_key)."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"), _text_key(text).alias("key"))
    needed = texts.join(classes.hint("merge"), F.expr("doc <=> rep and key = text_key")).dropDuplicates(["doc", "key", "id"]).select("id", "text")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", longs), T.StructField("wide", longs)])
    return written(needed.mapInArrow(_sets(n, 19), schema), "sets")


def _text_key(text: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _shared_ids(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes that an id with several texts belongs to."""
    rows = signed.filter("n_shingles > 0 and id is not null").select("id", F.struct("set_a", "set_b").alias("s"))
    several = written(rows.groupBy("id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo <> hi"), "several")
    if several.isEmpty():
        return None
    met = written(rows.join(several, "id").filter("s <> lo").select("s.*", F.col("lo.set_a").alias("lo_a"), F.col("lo.set_b").alias("lo_b")).distinct(), "shared")
    names = classes.select("set_a", "set_b", F.col("cid").alias("a"))
    other = names.withColumnsRenamed({"set_a": "lo_a", "set_b": "lo_b", "a": "b"})
    return written(met.join(names, ["set_a", "set_b"]).join(other, ["lo_a", "lo_b"]).select("a", "b"), "shared-links")


def _similar(left: str, right: str, percent: int) -> str:
    return f"(100 + {percent}) * size(array_intersect({left}, {right})) >= {percent} * (size({left}) + size({right}))"


def _rest(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that are still in different components.

    Every such pair is decided, but inside the join: only links become rows. A pair that meets in several buckets is
    decided in the one with the smallest key.
    """
    apart = "l.key = r.key and l.component <> r.component"
    parts = [f"w{i}" for i in range(WIDE // 32)]
    signed = placed.select("id", "key", "component").join(sets.selectExpr("id", *(f"wide[{i}] w{i}" for i in range(WIDE // 32))), "id")
    close = close_enough(similarity, WIDE, parts)
    open_ = written(signed.alias("l").join(signed.alias("r"), F.expr(f"{apart} and {close}"), "left_semi"), "open")
    keys = open_.groupBy("id").agg(F.collect_set("key").alias("keys"))
    full = open_.join(keys, "id").join(sets.select("id", "shingles"), "id")
    once = "l.key = array_min(array_intersect(l.keys, r.keys))"
    met = f"{apart} and l.id < r.id and {once} and {close} and {_similar('l.shingles', 'r.shingles', round(similarity * 100))}"
    return full.alias("l").join(full.alias("r"), F.expr(met)).selectExpr("l.id a", "r.id b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.75, pivot_rounds: int = 1) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id linked to it, directly or not), kept, text_key.

    Documents are compared by class, that is by set of shingles, so an id with several texts has several classes, which
    it links. A component without any id keeps the rows of its smallest class.
    """
    signed = written(signatures(docs, id_col, text, n), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", *BITS, "bands"))
    classes = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(first.alias("r"))
    # numbered once, when they are written
    classes = classes.select("set_a", "set_b", "r.*", F.monotonically_increasing_id().alias("cid")).drop("no_id").withColumnRenamed("id", "rep")
    classes = written(classes, "classes")
    buckets = classes.selectExpr("cid id", "explode(bands) key")
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # both sides of a join are tables of their own: Spark splits a hot key only where no aggregate sits below the join
    met = written(buckets.join(written(crowded, "keys"), "key"), "crowded").join(classes.select(F.col("cid").alias("id"), *BITS), "id")
    met = written(met, "buckets")
    close = close_enough(similarity, BANDS * ROWS, BITS)
    met = written(met.alias("l").join(met.alias("r"), F.expr(f"l.key = r.key and l.id <> r.id and {close}"), "left_semi"), "candidates")
    wanted = met.select("id").distinct().join(classes.select(F.col("cid").alias("id"), "rep", "text_key"), "id")
    sets = _full_sets(docs, written(wanted, "wanted"), id_col, text, n)
    links = _shared_ids(signed, classes)
    label = None if links is None else components(links)
    for turn in range(pivot_rounds + 1):
        if label is None:
            placed = met.withColumn("component", F.col("id"))
        else:
            placed = met.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
            placed = written(placed.join(written(mixed, "mixed"), "key"), "placed")
        if turn < pivot_rounds:
            rank = placed.groupBy("id").agg(F.struct(F.sum("n").alias("c"), F.xxhash64(F.lit(turn), F.col("id")).alias("h")).alias("o"))
            pivots = placed.join(rank, "id").groupBy("key").agg(F.max(F.struct("o", "id", "component", *BITS)).alias("p")).select("key", "p.*").drop("o")
            found = placed.alias("l").join(written(pivots, "pivots").alias("r"), F.expr(f"l.key = r.key and l.component <> r.component and {close}"))
            pairs = written(found.selectExpr("least(l.id, r.id) a", "greatest(l.id, r.id) b").distinct(), "pairs")
            joined = pairs.join(sets.selectExpr("id a", "shingles sa"), "a").join(sets.selectExpr("id b", "shingles sb"), "b")
            new = joined.filter(_similar("sa", "sb", round(similarity * 100))).select("a", "b")
        else:
            new = _rest(placed, sets, similarity)
        new = written(new, "confirmed")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            label = components(links)
    names = classes.select("set_a", "set_b", "cid", "rep")
    if label is None:
        names = names.withColumn("component", F.col("rep")).withColumn("first", F.lit(True))
    else:
        label = written(label.withColumnsRenamed({"id": "cid", "component": "group"}), "labels")
        members = written(names.join(label, "cid"), "members")
        least = written(members.groupBy("group").agg(F.min("rep").alias("component"), F.min(F.struct("set_a", "set_b")).alias("least")), "least")
        grouped = members.join(least, "group").select("set_a", "set_b", "component", (F.struct("set_a", "set_b") == F.col("least")).alias("first"))
        alone = names.join(label.select("cid"), "cid", "left_anti").select("set_a", "set_b", F.col("rep").alias("component"), F.lit(True).alias("first"))
        names = grouped.unionByName(alone)
    names = written(names.select("set_a", "set_b", "component", "first"), "names").hint("merge")
    empty = F.col("n_shingles") == 0
    rows = signed.join(names, ["set_a", "set_b"], "left").withColumn("component", F.when(empty, F.col("id")).otherwise(F.col("component")))
    kept = F.col("id").eqNullSafe(F.col("component")) & (F.col("id").isNotNull() | empty | F.col("first"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"), "text_key")
