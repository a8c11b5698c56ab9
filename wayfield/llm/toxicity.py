"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: lower case, look-alike letters of other alphabets to Latin ones, digits and signs that stand for letters to the
letters; everything else becomes one space. Terms are whole words (" idiot ") or beginnings of words (" lowe"); a word that
several terms hit counts once, with the largest weight. Words inside an exception phrase ("trash can") do not count.

Weights are learned from labelled rows: at most ``max_labelled`` of them, chosen by a hash of the id (the bound of the
sample; all other counts are over all of it). A term's evidence is the number of different words before it in toxic
rows, so copies of a row count once, against its occurrences in the others; terms whose evidence could be chance are left
out. Seed terms are kept unless the labels contradict them. The score is a logistic function of the log of the summed
weights and of the log of the number of words, fitted on the same sample: that is the normalisation by length.

Null texts are empty; empty texts have a score as well, that of no match. Without labels the seeds and ``START`` decide.
Rows of labels that repeat an id count once (toxic if any says so); null labels are none. Other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.store import written

# Letters that look like Latin ones, and signs used for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁһӏɡαορντυικ", "abekmhopctyxijsdhlgaopvtuik", strict=True))
SIGNS = dict(zip("0134578@$", "oieastbas", strict=True))
# Terms known without labels, and phrases in which a term is meant otherwise.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "jerk"]
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "clown fish", "circus clown", "birthday clown", "idiot proof"]
SEED_WEIGHT = 3.0
#: Intercept and the coefficients of log(1 + weights) and log(1 + words), where there are no labels.
START = (-4.0, 6.0, -0.2)
PREFIXES = (4, 5, 6)

_TABLE = str.maketrans(LOOKALIKES | SIGNS | {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)})
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words, each after one space, and a space at the end."""
    return _GAP.sub(" ", f" {(text or '').lower().translate(_TABLE)} ")


def terms_of(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) > n)]


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, the word before it: each pair once per batch."""
    for batch in batches:
        seen = set()
        for text in batch.column(0).to_pylist():
            before = ""
            for word in fold(text).split():
                if len(word) > 2:
                    seen.update((term, before) for term in terms_of(word))
                before = word
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*seen, strict=True)], names=["term", "before"])


def _counts(terms: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = fold(text).split()
                words += len(own)
                for word, times in Counter(own).items():
                    for term in terms_of(word):
                        if term in terms:
                            found[term] += times
        found[""] = words
        yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})

    return run


@lru_cache(maxsize=2)
def automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in terms:
        out.add_word(term, (len(term), weight))
    for phrase in exceptions:
        folded = fold(phrase)
        out.add_word(folded, (len(folded), 0.0))
    if len(out):
        out.make_automaton()
    return out


def weigh(text: str | None, machine) -> tuple[float, int, int]:
    """Summed weights, words hit, and words."""
    folded = fold(text)
    words = folded.count(" ") - 1 if len(folded) > 1 else 0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded) if len(machine) else ():
        start = end - size + 1
        if weight:
            hits[start] = max(weight, hits.get(start, 0.0))
        else:
            spared.append((start, end))
    if spared and hits:
        # the furthest end of all phrases that begin up to each start
        spared.sort()
        begins, ends = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
        hits = {at: w for at, w in hits.items() if not (k := bisect.bisect_right(begins, at)) or ends[k - 1] <= at}
    return sum(hits.values()), len(hits), words


def _weigher(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms, exceptions)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rows = [weigh(x.as_py(), machine) for x in batch.column(at)]
            values = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *values], names=[*(batch.schema.names[i] for i in kept), "weight", "n_hits", "n_words"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, start: tuple[float, ...], ridge: float = 0.05, steps: int = 50) -> tuple[float, ...]:
    """Coefficients by Newton's method, held to the start by a ridge; the intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    b0 = np.array(start)
    b = b0.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (b - b0)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 20_000, evidence: float = 12.0, purity: float = 0.8) -> tuple[tuple[tuple[str, float], ...], tuple[float, ...]]:
    """Terms with weights, and the coefficients of the score. Only the rows of ``labels`` are learned from."""
    spark = docs.sparkSession
    one = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = written(one.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled), "labelled")
    # at most max_labelled rows: an id that rows repeat is learned from once
    sample = docs.select(id_col, F.col(text).alias("t")).join(F.broadcast(chosen), id_col)
    sample = sample.groupBy(id_col).agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y")).select("t", "y")
    sample = written(sample.repartition(max(1, spark.sparkContext.defaultParallelism)), "sample")
    toxic, clean = sample.filter("y = 1").select("t"), sample.filter("y = 0").select("t")
    seen = toxic.mapInArrow(_toxic_terms, "term string, before string").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    toxic_n = dict(map(tuple, seen.collect()))
    seeds = {f" {w} " for w in SEEDS}
    wanted = set(toxic_n) | seeds

    def counted(rows: DataFrame) -> dict[str, int]:
        return dict(map(tuple, rows.mapInArrow(_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n")).collect()))

    clean_n, all_toxic = counted(clean), counted(toxic)
    total_t, total_c = all_toxic.get("", 0), clean_n.get("", 0)
    base = (total_t + 1) / (total_t + total_c + 2)
    terms = {}
    for term in wanted:
        t, c = toxic_n.get(term, 0), clean_n.get(term, 0)
        p = (t + 0.5) / (t + c + 1)
        gain = t * math.log(p / base) + c * math.log((1 - p) / (1 - base)) if t else 0.0
        if p >= purity and gain >= evidence:
            terms[term] = min(6.0, math.log(p / (1 - p) * (1 - base) / base))
        elif term in seeds and p >= 0.5:
            terms[term] = SEED_WEIGHT
    lexicon = tuple(sorted(terms.items()))
    rows = sample.mapInArrow(_weigher(lexicon, tuple(EXCEPTIONS), "t"), "y int, weight double, n_hits long, n_words long").collect()
    if not rows:
        return lexicon, START
    x = np.log1p(np.array([[r["weight"], r["n_words"]] for r in rows], dtype=float))
    return lexicon, logistic(x, np.array([float(r["y"]) for r in rows]), START)


def score(docs: DataFrame, lexicon: tuple[tuple[str, float], ...], model: tuple[float, ...], text: str = "text", exceptions: tuple[str, ...] = tuple(EXCEPTIONS)) -> DataFrame:
    """The other columns of ``docs`` (but those of the following names), weight, n_hits, n_words and score (0 to 1)."""
    docs = docs.drop("weight", "n_hits", "n_words", "score")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    found = docs.mapInArrow(_weigher(lexicon, exceptions, text), f"{kept}, weight double, n_hits long, n_words long")
    b0, b1, b2 = model
    return found.withColumn("score", 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.log1p("weight") + F.lit(b2) * F.log1p("n_words")))))
