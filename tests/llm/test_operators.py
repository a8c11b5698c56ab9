"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.llm import chat, decontaminate, minhash, mixing, ngram, quality, store, substring, text, tokens, toxicity, warc
from wayfield.llm.queries import ORACLE, QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = "id string, text string, lang string, source string, n_chars long, size long, d string, f string, key string, hash string, copies long, n_removed long, weight double, component string, text_key long, part string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t: str | None) -> list[str]:
    return re.findall(SPACE, t or "")


def low(t: str | None) -> list[str]:
    return words((t or "").translate(LOWER))


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    out: list[tuple] = []
    for i in range(40):  # near copies with a few changed words, and exact ones
        w = base.split(" ")
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        out.append((i, " ".join(w), "en", "hot", None))
    out += [(100 + i, base if i % 2 else base.upper(), "en", "hot", 1) for i in range(10)]
    out += [(200 + i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", None]), 1) for i in range(60)]
    out += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n\x0b ", "en", "a", 5), (303, "one", "en", "a", 3), (304, "One", "en", "b", 3), (305, "a b c d", "en", "b", 7)]
    out += [(306, "Ünïcode 日本 " * 30 + "\x00 end.", "xx", "a", None), (307, prose(rng, 9000), "en", "b", None), (308, "z" * 30000, "en", "b", 30000)]
    out += [out[0], out[0], (None, base, "en", "hot", 1), (None, None, None, None, None), (None, "alone here", "en", None, 1)]
    passage = prose(rng, 70, 5000)
    out += [(400 + i, f"{prose(rng, 40)}.\n{passage}.\n{prose(rng, 40)}", "en", "a", 1) for i in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """The same documents with further columns whose names operators use themselves."""
    more = [c.split() for c in CLASH.split(", ") if c.split()[0] not in docs.columns]
    return docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in more))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_grams_match_regular_expressions(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    data, offsets = text.utf8(pa.array(texts, type=pa.string()))
    for member, pattern in ((text.NOT_SPACE, SPACE), (text.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = text.Words(data, offsets, member)
        expected = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        assert list(found.counts) == [len(e) for e in expected]
        by_hash = collections.defaultdict(set)
        for h, w in zip(found.hashes.tolist(), itertools.chain(*expected), strict=True):
            by_hash[h].add(w)
        assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({*itertools.chain(*expected)})
        grams, _ = text.grams(found.hashes, found.rows, 3)
        assert len(grams) == sum(max(0, len(e) - 2) for e in expected)
        assert len({*grams.tolist()}) == len({tuple(e[i : i + 3]) for e in expected for i in range(len(e) - 2)})


def shingles(t: str | None) -> frozenset:
    w = low(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(sets: dict) -> dict:
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in sets}


def test_near_duplicates_are_the_exact_components(clashing, rows, empty):
    got = minhash.near_duplicates(clashing).collect()
    assert len(got) == len(rows)
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    expected = components_of(sets)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], r.doc_id == expected[r.doc_id]), r
    nulls = sorted((r.n_shingles, r.component_id is None, r.kept) for r in got if r.doc_id is None)
    assert [n[1:] for n in nulls] == [(True, True), (True, True), (False, False)] and [n[0] for n in nulls[:2]] == [0, 1]
    assert minhash.near_duplicates(empty).count() == 0


def test_groups_without_a_centre_lose_no_link(spark):
    """A chain: each text shares three quarters with the next only, so no pivot reaches all."""
    w = [f"v{i}" for i in range(600)]
    chain = [(i, " ".join(w[10 * i : 10 * i + 104])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == components_of({i: shingles(t) for i, t in chain}) and set(got.values()) == {0}


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    assert {r.id: r.component for r in minhash.components(links).collect()} == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_quality_counts_and_votes(clashing, rows, empty):
    got = quality.judge(clashing).collect()
    assert len(got) == len(rows) and "component" in got[0]["d"].asDict()
    for r in got:
        w, t = words(r["d"]["text"]), r["d"]["text"] or ""
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        f = r["f"]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
        ), t[:80]
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(empty).count() == 0


def test_quality_rejects_what_labels_call_bad(spark):
    judged = QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").toPandas()
    named = judged.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    bad, good = named[named.quality_y == 0], named[(named.quality_y == 1) & ~named.base_failed]
    assert (~bad.kept).mean() > 0.9 and good.kept.mean() > 0.98


def test_em_finds_the_rates_of_independent_rules(spark, monkeypatch):
    monkeypatch.setattr(quality, "RULES", [(f"r{i}", "", "", "") for i in range(4)])
    rng = np.random.default_rng(3)
    bad = rng.random(20000) < 0.2
    votes = {f"r{i}": np.where(rng.random(20000) < 0.2, None, (rng.random(20000) < np.where(bad, 0.8, 0.05)).astype(int)) for i in range(4)}
    counts = collections.Counter(zip(*(votes[r].tolist() for r in votes), strict=True))
    table = spark.createDataFrame([(*k, n) for k, n in counts.items()], "r0 int, r1 int, r2 int, r3 int, n long")
    found = quality.estimate(table)
    assert abs(found.bad - 0.2) < 0.02 and all(abs(a - 0.8) < 0.04 and abs(b - 0.05) < 0.02 for a, b in found.rules.values())


def test_contamination_is_exact_for_long_and_short_items(spark, clashing, rows, empty):
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(alnum, (t or "").translate(LOWER))
    items = [(1, " ".join(rows[0][1].split(" ")[20:60])), (10, "one"), (2, "a b c d"), (3, None), (4, "... !"), (5, " ".join(rows[-1][1].split(" ")[41:60])), (5, "w1 w2"), (None, "alone here"), (2, "a b c d")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(clashing, table).collect()
    index = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            index[tuple(w[k : k + 13])].add(i)
    by_text = collections.Counter()
    for r in got:
        by_text[r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)] += 1
    expected = collections.Counter()
    for r in rows:
        w, hit, names = cut(r[1]), set(), set()
        for size in {len(k) for k in index}:
            for k in range(len(w) - size + 1):
                if found := index.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    names |= {str(x) for x in found if x is not None}
        expected[r[0], len(w), len(hit), ",".join(sorted(names))] += 1
    assert by_text == expected and any(k[2] for k in expected)
    assert decontaminate.contamination(empty, table).count() == 0
    none = decontaminate.contamination(clashing, table.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    rows_of = np.repeat([1, 2], [200, 300])
    kept = set(decontaminate.winnow(hashes, None, rows_of, 8).tolist())
    for i in range(493):
        if rows_of[i] == rows_of[i + 7]:
            assert any(j in kept for j in range(i, i + 8))


def fill(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    free, total = set(order), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in order if s not in free)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: level * weight[s] if s in free else most * sizes[s] for s in order}
        free -= over


def test_mixing_reaches_targets(clashing, rows, empty):
    got = mixing.mix(clashing, chunk_rows=5, fan=2).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = fill(dict(sizes))
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, target[s]) and 0 <= r.copies <= 2 for r in mine)
        repeats = collections.Counter((r.doc_id, r.size) for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= max(n * k[1] for k, n in repeats.items()) + 1e-6
    again = mixing.mix(clashing.repartition(3), chunk_rows=5, fan=2).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0


def test_mixing_is_fair(spark):
    """Over seeds, each document is taken as often as its share says."""
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    total, wanted = collections.Counter(), {}
    for seed in range(12):
        for r in mixing.mix(docs, chunk_rows=8, fan=2, seed=seed * 100).collect():
            total[r.doc_id] += r.copies
            wanted[r.doc_id] = r.target / r.source_size
    assert abs(sum(total.values()) / 12 - sum(wanted.values())) < 2.5
    docs.unpersist()


def test_repeated_passages_go_and_first_ones_stay(clashing, rows, empty):
    out = substring.without_repeats(clashing)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.count() == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    for i in (400, *range(200, 260), 300, 301, 302, 303, 305, 306, 307, 308):
        if not got[i].n_removed:
            assert got[i].text == text_of[i]
    assert not got[400].n_removed and all(got[i].n_removed and got[i].text != text_of[i] for i in range(401, 405))
    lost = set(words(text_of[401])) - set(words(got[401].text))
    assert len(lost) > 30 and all(len(words(got[i].text)) < 100 for i in range(401, 405))
    assert got[0].text == text_of[0] and not words(got[101].text) and got[301].text == "" and got[300].text is None
    assert substring.without_repeats(empty).count() == 0


def test_spans_against_brute_force(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    data, offsets = text.utf8(pa.array(texts, type=pa.string()))
    found = text.Words(data, offsets, text.NOT_SPACE)
    starts = substring.sentences(data, found)
    first, count, hashes = substring.spans(found, starts, 2, 24, 40)
    ends = np.append(starts[1:], len(found.hashes))
    flat = [w for t in texts for w in low(t)]
    seen = collections.defaultdict(set)
    for f, n, h in zip(first, count, hashes.tolist(), strict=True):
        run = tuple(tuple(flat[starts[k] : ends[k]]) for k in range(f, f + n))
        size = sum(map(len, run))
        assert size >= 40 or (size >= 24 and n >= 2)
        assert n == 1 or sum(map(len, run[:-1])) < 40 and (sum(map(len, run[:-1])) < 24 or n - 1 < 2)
        seen[h].add(run)
    assert seen and all(len(v) == 1 for v in seen.values())


def test_cuts_inside_a_sentence_follow_content():
    import pyarrow as pa

    rng = random.Random(9)
    passage = [f"w{rng.randrange(900)}" for _ in range(90)]
    same = []
    for before in (0, 5, 30, 47, 200):
        data, offsets = text.utf8(pa.array([" ".join([f"v{i}" for i in range(before)] + passage + ["end."] * (before % 3))]))
        starts = substring.sentences(data, text.Words(data, offsets, text.NOT_SPACE)) - before
        same.append([int(x) for x in starts if 48 <= x < 80])
    assert same[0] and all(s == same[0] for s in same)
    # a run of one word, whatever its hash, is no sentence of any length
    for i in range(20):
        data, offsets = text.utf8(pa.array([f"spam{i} " * 300]))
        starts = substring.sentences(data, text.Words(data, offsets, text.NOT_SPACE))
        assert np.diff(np.append(starts, 300)).max() < 60


def test_repeats_of_one_word_go(spark):
    docs = spark.createDataFrame([(i, f"spam{i} " * 300) for i in range(12)], "doc_id long, text string")
    assert all(len(words(r.text)) < 60 for r in substring.without_repeats(docs).collect())


def test_passages_are_cut_whole_wherever_they_are_pasted(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        n = rng.choice([50, 53, 60, 90, 200])
        marked = rng.random() < 0.7
        p = [f"p{i}x{j}" + (rng.choice(["", "", "", ".", ".\n"]) if marked else "") for j in range(n)]
        for copy in range(3):  # pasted inside a sentence, after text without an end mark
            before = [f"a{i}c{copy}x{j}" + ("." if j % 11 == 9 else "") for j in range(rng.choice([0, 7, 22, 71]))]
            after = [f"b{i}c{copy}x{j}" + ("." if j % 9 == 8 else "") for j in range(rng.choice([0, 5, 40]))]
            rows.append((3 * i + copy, " ".join(before + p + after), " ".join(before + after)))
    # sentences of 31, 6 and 16 words, the first one glued to other text in the copy
    shared, glued = " ".join(f"s{j}" + ("." if j in (30, 36, 52) else "") for j in range(53)), " ".join(f"u{j}" for j in range(22))
    rows += [(900, shared, shared), (901, f"{glued} {shared}", glued)]
    got = {r.doc_id: r for r in substring.without_repeats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, whole, rest in rows:
        if i == 900 or i < 900 and i % 3 == 0:
            assert got[i].text == whole and not got[i].n_removed
        else:
            assert words(got[i].text) == words(rest) and got[i].n_removed, i


def test_windows_read_back(spark):
    rng = random.Random(2)
    hard = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "&lt;&amp;[&#91;", "", None, "日本\n\n", "<|end|>" * 50]
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, ("system" if rng.random() < 0.5 else "user") if t == 0 else ["assistant", "user"][t % 2 - 1], rng.choice(hard + [prose(rng, 150)])))
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} {prose(rng, 20)}") for t in range(1200)]
    rows += [(60, 1, "user", "tie b"), (60, 1, "user", "tie a"), (60, None, "assistant", "first"), (60, 1, "user", "tie a"), (61, 0, None, "role"), (None, 0, "user", "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash")).withColumn("window", F.lit(1))
    made = store.written(chat.windows(turns), "windows")
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(mine), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    long = made.filter("conv_id = 50").collect()
    assert len(long) > 20 and all(w.tokens <= 512 for w in long) and any(t.repeated for w in long for t in w.turns)
    assert chat.read_back(chat.windows(turns.limit(0))).count() == 0


def test_archives_round_trip(spark):
    big = "x" * 100
    rows = [(3, "http://a/é\r\n", big), (1, None, big), (2, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "日" * 50_000), (7, "u", "日" * 50_000), (None, "u", big), (8, "u", "日" * 34)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit("x"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    expected = collections.Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        first = min(same) if len(body) >= 100 else i
        expected[i, len(body), hashlib.sha256(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first] += 1
    assert got == expected
    folder = store.fresh(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, archive_bytes=300)
    back = warc.read_archives(manifest, folder, payloads=True).filter("type = 'response'").collect()
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in back) and manifest.count() > 1
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("damage", ["cut", "digest", "length", "tail"])
def test_damaged_archives_are_refused(damage):
    import io

    fields = {"WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"body").hexdigest()}
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"
    good = warc.record("response", fields, [http, b"body"])
    bad = {"cut": good[:-9], "digest": warc.record("response", fields, [http, b"BODY"]), "length": warc.record("response", fields, [http, b"body!"]), "tail": good + b"junk"}[damage]
    assert [warc._payload(m, True)[1] for m in warc.Stream(io.BytesIO(good * 3))] == [4, 4, 4]
    with pytest.raises((ValueError, zlib.error)):
        [warc._payload(m, True) for m in warc.Stream(io.BytesIO(bad))]


def test_section_tokens_follow_the_rule(spark, clashing, rows, empty):
    path = tokens.default_vocabulary()
    encoder, lengths = tokens.vocabulary(path)
    by_rule = {rule: tokens.section_tokens(clashing, rule=rule).collect() for rule in ("first", "last", "most")}
    for rule, got in by_rule.items():
        sums = collections.Counter()
        for r in got:
            sums[r.doc_id] += r.n_tokens
        expected = collections.Counter()
        for r in rows:
            expected[r[0]] += len(encoder.encode_ordinary("\n".join([r[3] or "", r[2] or "", r[1] or ""])))
        assert sums == expected, rule
    # brute force over one document: a token and the section of its bytes
    source, lang, body = "src", "en", "one\n\n\ntwo  three\n four\n"
    one = spark.createDataFrame([(1, body, lang, source)], "doc_id long, text string, lang string, source string")
    whole = "\n".join([source, lang, body]).encode()
    starts = [0, 4, 7] + [7 + i + 1 for i, c in enumerate(body) if c == "\n" and i + 1 < len(body)]
    owner = [max(k for k, s in enumerate(starts) if s <= i) for i in range(len(whole))]
    spans, at = [], 0
    for t in encoder.encode_ordinary(whole.decode()):
        spans.append(owner[at : at + int(lengths[t])])
        at += int(lengths[t])
    pick = {"first": lambda s: s[0], "last": lambda s: s[-1], "most": lambda s: max(sorted(set(s)), key=s.count)}
    for rule in pick:
        want = collections.Counter(pick[rule](s) for s in spans)
        got = [r.n_tokens for r in tokens.section_tokens(one, rule=rule).collect()]
        assert got == [want[k] for k in range(len(starts))], rule
    assert tokens.section_tokens(empty).count() == 0
    long = prose(random.Random(1), 3000)
    assert [t for p in tokens.pieces(long, 500) for t in encoder.encode_ordinary(p)] == encoder.encode_ordinary(long)


def test_toxicity_folds_weighs_and_spares(spark, empty):
    terms = ((" idiot ", 3.0), (" trash ", 2.0), (" idio", 1.0))
    machine = toxicity.automaton(terms, ("trash can",))
    assert toxicity.weigh("An ІD10T, a Trash; trash can! $", machine)[:2] == (5.0, 2)
    assert toxicity.weigh(None, machine) == (0.0, 0, 0) and toxicity.weigh("idiotic", machine)[:2] == (1.0, 1)
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + (f" blargh{'xyz'[i % 3]}{i % 5} " if i % 4 == 0 else " ") + prose(rng, 20), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit(2.0)).withColumn("weight", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    lexicon, model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    seeds, start = toxicity.learn(docs, labels.limit(0))
    assert start == toxicity.START and len(seeds) == len(toxicity.SEEDS)
    assert toxicity.score(empty.select("doc_id", "text"), lexicon, model).count() == 0


def test_toxicity_on_held_out_documents(spark):
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.01


def test_elias_fano_lists():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000, 30000):
        v = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        coded = ngram.EliasFano.build(v, 1 << 64)
        assert (coded.find(v) == np.arange(len(v))).all() and (coded.get(np.arange(len(v))) == v).all()
        assert (coded.find(v + np.uint64(1)) == -1).all()
        crowd = np.unique(np.append(v % np.uint64(5 * n), np.uint64(5 * n)))
        dense = ngram.EliasFano.build(crowd, int(crowd[-1]) + 1)
        assert (dense.find(crowd) == np.arange(len(crowd))).all()
    assert (ngram.EliasFano.build(np.zeros(0, dtype=np.uint64), 10).find(np.array([3], dtype=np.uint64)) == -1).all()


def test_pairs_level_answers_from_its_pointers():
    context, word = np.array([5, 5, 5, 9, 9, 1 << 60], dtype=np.uint64), np.array([1, 2, 7, 2, 3, 4], dtype=np.uint64)
    level = ngram.Pairs(np.frombuffer(ngram.Pairs.pack(context, word, np.arange(6, dtype=np.uint8)), dtype=np.uint8))
    assert [x.tolist() for x in level.successors(9)] == [[2, 3], [3, 4]] and len(level.successors(6)[0]) == 0


def test_language_model_scores(clashing, rows, empty):
    model = ngram.train(clashing.filter("doc_id % 7 <> 2"), shard_bytes=20_000)
    assert len(model.pairs) > 2
    got = ngram.score(clashing, model).collect()
    assert any(model.triples)
    count, pair, triple, texts = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for r in rows:
        if r[0] is not None and r[0] % 7 != 2:
            t = [*low(r[1]), "\0end"]
            count.update(t)
            pair.update(zip(["\0begin", *t[:-1]], t, strict=True))
            triple.update(zip(["\0begin", *t[:-2]], t[:-1], t[1:]))
            texts += 1
    triple = {k: n for k, n in triple.items() if n >= 2}
    kept = collections.Counter()
    for (a, b, _), times in triple.items():
        kept[a, b] += times
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.types, model.documents) == (n, v, texts)
    expected = collections.defaultdict(list)
    seen = count | {"\0begin": texts}
    for r in rows:
        t = [*low(r[1]), "\0end"]
        plain = [(count[w] + 1) / (n + v + 1) for w in t]
        full = [pair[a, b] / (seen.get(a, 0) + 300) + 300 / (seen.get(a, 0) + 300) * p for a, b, p in zip(["\0begin", *t[:-1]], t, plain, strict=True)]
        for i, (a, b, c) in enumerate(zip(["\0begin", *t[:-2]], t[:-1], t[1:]), start=1):
            if kept[a, b]:
                full[i] = triple.get((a, b, c), 0) / (pair[a, b] + 3) + (1 - kept[a, b] / (pair[a, b] + 3)) * full[i]
        expected[r[0]].append((len(t), sum(count[w] > 0 for w in t), sum(map(math.log10, plain)), sum(map(math.log10, full))))
    for r in got:
        near = [e for e in expected[r.doc_id] if e[:2] == (r.n_tokens, r.n_known) and abs(e[2] - r.base_score) < 1e-6]
        assert near and any(e[3] - 0.0021 * e[0] <= r.score <= e[3] + 1e-6 for e in near), r
    nothing = ngram.train(empty)
    assert ngram.score(empty, nothing).count() == 0 and ngram.score(clashing, nothing).filter("score <> 0").count() == 0


def test_warc_query_agrees_with_sql(spark):
    from compare import connect

    got = sorted(map(tuple, QUERIES["op8_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    sql = f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLE['op8_warc']}) order by all"
    assert got == connect(SF).execute(sql).fetchall()
