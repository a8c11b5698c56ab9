"""Very long texts, repeated ids, hot pages and long runs: the cases that small tables do not show."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.llm import chat, minhash, ngram, store, text, tokens, toxicity, warc


@pytest.mark.parametrize("size", [3, 8, 1 << 20])
def test_words_do_not_depend_on_pieces(monkeypatch, size):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab cD é\n") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "x" * 30, " "]
    data = [r.encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    whole = np.frombuffer(b"".join(data), dtype=np.uint8)
    want = text.Words(whole, offsets, text.NOT_SPACE)
    monkeypatch.setattr(text, "PIECE", size)
    got = text.Words(whole, offsets, text.NOT_SPACE)
    for name in ("starts", "ends", "rows", "hashes"):
        assert (getattr(got, name) == getattr(want, name)).all()
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", r)) for r in rows] == got.counts.tolist()


def test_fifty_megabytes_in_bounded_memory():
    """Cut and hashed in a process of its own, which tells its peak."""
    import subprocess
    import sys

    program = (
        "import resource, numpy as np\nfrom wayfield.llm import text as T\n"
        "data = np.frombuffer(b'several words of one long text, again and again. ' * 1_050_000, dtype=np.uint8)\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nw = T.Words(data, np.array([0, len(data)]), T.NOT_SPACE)\n"
        "print(len(w.hashes), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    words, used = map(int, subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert words == 9 * 1_050_000 and used < 700


def test_one_long_text_scores_like_its_parts(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, None)], "doc_id long, text string")
    model = ngram.train(docs.filter("doc_id < 3"))
    want = ngram.score(docs, model).orderBy("doc_id").collect()
    kept = ngram.SLICE
    try:
        ngram.SLICE = 1000
        got = ngram.score(docs, model).orderBy("doc_id").collect()
    finally:
        ngram.SLICE = kept
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)


def test_shares_of_a_frequent_context_sum_to_one_at_most():
    times = np.array([1, 5, 10**6, 10**9 - 10**6 - 6], dtype=np.int64)
    code = ngram.share_codes(times, np.full(4, 10**9), ngram.MU)
    share = 10.0 ** (-ngram.STEP * code)
    assert share.sum() <= 1 and (share <= times / (10**9 + ngram.MU)).all() and np.allclose(share, times / 1e9, rtol=0.01)


def test_successors_are_searched_between_their_pointers():
    rng = np.random.default_rng(3)
    context = np.sort(rng.choice(rng.integers(0, 1 << 63, 50).astype(np.uint64), 4000))
    word = rng.integers(0, 1 << 40, 4000).astype(np.uint64)
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    code = rng.integers(0, 60_000, 4000).astype(np.uint16)
    pairs = ngram.Pairs(np.frombuffer(ngram.Pairs.pack(context, word, code), dtype=np.uint8))
    full = word << np.uint64(24)
    assert np.allclose(pairs.share(context, full), 10.0 ** (-ngram.STEP * code))
    assert (pairs.share(context, np.roll(full, 1) ^ np.uint64(1 << 30)) == 0).mean() > 0.99
    found, codes = pairs.successors(int(context[0]))
    assert (found == word[context == context[0]]).all() and (codes == code[context == context[0]]).all()


def test_ids_with_several_texts_keep_their_links(spark):
    rng = random.Random(6)
    say = lambda: [f"v{rng.randrange(9999)}" for _ in range(80)]
    a, b, c = say(), say(), say()
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (9, " ".join(c)), (9, " ".join(c)), (None, near(c)), (None, " ".join(a)), (11, "")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 2)
        got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
        assert got == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (None, 9, False), (None, 5, False), (11, 11, True)}


def test_copies_without_an_id_leave_one(spark):
    rng = random.Random(7)
    base = " ".join(f"u{rng.randrange(9999)}" for _ in range(60))
    docs = spark.createDataFrame([(None, base), (None, base + " more"), (None, "another text without an id"), (None, base)], "doc_id long, text string")
    kept = minhash.near_duplicates(docs).filter("kept").select("text_key").distinct().count()
    assert kept == 2


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "u", ("same page " * 30) if i % 2 else f"page {i} " * 40) for i in range(400)] + [(1000 + i, None, "") for i in range(50)], "page_id long, url string, html string").repartition(6)
    folder = store.fresh(spark, "warc-many")
    manifest = warc.write_archives(pages, folder, archive_bytes=4000)
    back = warc.read_archives(manifest, folder)
    tasks = back.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert manifest.count() > 8 and len(tasks) >= 6 and sum(r["count"] for r in tasks) == 450
    assert back.filter("type = 'revisit'").count() == 199


def test_turns_without_numbers_are_cut_into_blocks(spark):
    rows = [(1, None if i % 2 else 7, "user" if i % 3 else "assistant", f"text {i} " * 5) for i in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.numbered(df, block=64).orderBy("n").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert [(r.role, r.text) for r in got] == [r[2:] for r in want] and [r.n for r in got] == list(range(1200))
    assert [r.before for r in got] == [0, *np.cumsum([r.tokens for r in got])[:-1]]


def test_many_exceptions_take_linear_time():
    machine = toxicity.automaton((("trash", 2.0),), ("trash can",))
    began = time.time()
    assert toxicity.weigh("trash trash can " * 40_000, machine)[1] == 40_000
    assert time.time() - began < 20


def test_labelled_rows_are_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"bad stuff {i}") for i in range(500)] + [(2, "fine words")], "doc_id long, text string")
    lexicon, model = toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert len(model) == 3


def test_long_runs_are_cut_where_tokens_begin():
    rng = random.Random(9)
    encoder, _ = tokens.vocabulary(tokens.default_vocabulary())
    for source in ("".join(rng.choice("abcXYZ0123456789+/") for _ in range(6000)), "".join(rng.choice(["a1", "b'", "'s9", "--", "日7"]) for _ in range(3000))):
        parts = list(tokens.pieces(source, 500))
        assert len(parts) > 5 and "".join(parts) == source
        assert [t for p in parts for t in encoder.encode_ordinary(p)] == encoder.encode_ordinary(source)


def test_a_document_of_nulls_has_a_section_per_field(spark):
    docs = spark.createDataFrame([(1, None, None, None)], "doc_id long, source string, lang string, text string")
    rows = tokens.section_tokens(docs).collect()
    assert len(rows) == 3 and sum(r.n_tokens for r in rows) == rows[0].doc_tokens


def test_triples_are_searched_between_the_pointers_of_their_pair():
    rng = np.random.default_rng(4)
    place = np.sort(rng.choice(500, 3000))
    place = place[(place % 3 != 0) | (place == 0)]
    word = rng.integers(0, 1 << 40, len(place)).astype(np.uint64)
    order = np.lexsort((word, place))
    place, word = place[order], word[order]
    share = rng.integers(1, 60_000, len(place)).astype(np.uint16)
    some = np.unique(place)
    rest = rng.integers(1, 60_000, len(some)).astype(np.uint16)
    level = ngram.Triples(np.frombuffer(ngram.Triples.pack(600, place, word, share, rest), dtype=np.uint8))
    got, left = level.share(place, word << np.uint64(24))
    assert np.allclose(got, ngram.decode(share)) and np.allclose(left, ngram.decode(rest)[np.searchsorted(some, place)])
    none, all_left = level.share(np.array([3, 599]), word[:2] << np.uint64(24))
    assert (none == 0).all() and (all_left == 1).all()
    unknown, left = level.share(place, (word ^ np.uint64(1)) << np.uint64(24))
    assert (unknown > 0).mean() < 0.01 and (left < 1).all()


def test_tables_of_frequent_pairs_never_miss_one():
    rng = np.random.default_rng(5)
    for n in (1, 3, 1000, 70_000):
        context, word = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 40, n).astype(np.uint64)
        table = ngram.bit_table(context, word)
        assert ngram.in_table(table, context, word).all()
        assert ngram.in_table(table, context, word ^ np.uint64(1 << 39)).mean() < 0.05 or n < 10
