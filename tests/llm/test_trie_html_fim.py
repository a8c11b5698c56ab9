"""Conversation trie, main text and fill-in-middle against brute force, on nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.llm import fim, html, order, trie

TURNS = "conv_id long, turn long, role string, text string, n long, a long, seg string, c string, part string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- rows in order


def test_numbers_go_on_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(50)]), f"x{i}") for i in range(3000)]
    got = order.numbered(spark.createDataFrame(rows, "k long, t long, x string").repartition(7), "k", ["t", "x"]).collect()
    for key in (1, 2, None):
        want = sorted(((-1 if t is None else t), x) for k, t, x in rows if k == key)
        assert [((-1 if r.t is None else r.t), r.x) for r in sorted((r for r in got if r.k == key), key=lambda r: r.n)] == want
        assert sorted(r.n for r in got if r.k == key) == list(range(len(want)))


# --- conversation trie


def brute_trie(convs: dict) -> list[tuple]:
    paths = {c: [tuple(t[:d]) for d in range(len(t) + 1)] for c, t in convs.items()}
    last = (float("inf"),)
    rank = lambda c: last if c is None else (c,)
    members: dict[tuple, list] = {}
    for c in sorted(convs, key=rank):
        for p in paths[c]:
            members.setdefault(p, []).append(c)
    kids: dict[tuple, int] = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ["" if c is None else str(c) for c in sorted((c for c in m if len(convs[c]) == len(p)), key=lambda c: (c is not None, c or 0))]
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(",".join(ends))))
    return out


def nodes(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def frame(spark, convs: dict, seed: int = 0):
    rows = [(c, i, r, t, 7, 8, "s", "c", "p") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize(("segment", "shard"), [(1024, 1 << 14), (4, 8), (1, 1)])
def test_trie_like_brute_force(spark, segment, shard):
    rng = random.Random(3)
    say = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "hi", "ok é", "日本"]))
    convs = {c: [say() for _ in range(rng.randrange(1, 7))] for c in range(60)}
    long = [say() for _ in range(40)]
    convs |= {100 + c: long[: rng.randrange(1, 41)] + [("user", f"x{c % 3}")] * rng.randrange(3) for c in range(20)}
    convs |= {200: list(convs[5]), 201: list(convs[5]), None: list(convs[5]), 300: [("", "")] * 9}
    rows = trie.turn_digests(frame(spark, convs))
    every = spark.createDataFrame([(c,) for c in [*convs, 999]], "c long")
    assert nodes(trie.prefix_trie(rows, every, segment, shard)) == sorted(brute_trie(convs | {999: []}), key=str)


def test_trie_of_rebuilt_conversations_with_nulls(spark):
    rng = random.Random(4)
    own = {c: [(rng.choice(["u", None]), rng.choice([None, "", "a", "bb"])) for _ in range(rng.randrange(1, 9))] for c in [0, 1, 2, 3, 50, 99, 100, 101, 250, 251, 300, 399, 400, 401, 402]}
    filled = {c: [(r or "", t or "") for r, t in turns] for c, turns in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: filled.get(c - c % 100, [])[: head[c]] + filled[c][head[c] :] for c in own}
    assert any(not turns for turns in built.values())
    got = trie.prefix_trie(*trie.shared_heads(trie.turn_digests(frame(spark, own | {None: [("u", "a")]}))))
    assert nodes(got) == sorted(brute_trie(built | {None: [("u", "a")]}), key=str)


def test_trie_orders_null_turns_first_and_keeps_repeated_rows(spark):
    rows = [(1, 5, "u", "z"), (1, None, "u", "y"), (1, 2, "u", "x"), (1, 2, "u", "x"), (2, 1, "u", "y"), (2, 2, "u", "x"), (2, 3, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digests = trie.turn_digests(df)
    got = trie.prefix_trie(digests, digests.select("c").distinct())
    u = lambda *x: [("u", t) for t in x]
    assert nodes(got) == sorted(brute_trie({1: u("y", "x", "x", "z"), 2: u("y", "x", "x")}), key=str)


def test_empty_trie(spark):
    rows, convs = trie.shared_heads(trie.turn_digests(spark.createDataFrame([], TURNS)))
    assert trie.prefix_trie(rows, convs).count() == 0


def test_node_table_is_minimal_and_verifies():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    table = trie.NodeTable(np.append(a, a[:700]), np.append(b, b[:700]))
    slots = table.slots(a, b)
    assert table.size == 5000 and sorted(slots) == list(range(5000))
    with pytest.raises(ValueError, match="node table"):
        table.slots(a, b ^ 1)


# --- main text

LABELLED = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>one</a></li></ul></nav><div class='ad'>buy this now</div><article><h1>Head</h1><p>%s</p></article><div class='zork'>strange words here again</div><footer>foot words</footer></body></html>"


@pytest.fixture(scope="module")
def page_text(spark):
    pages = spark.createDataFrame([(i, "u", LABELLED % f"some words {i} of text that go on") for i in range(50)], "page_id long, url string, html string")
    learned = html.weights(pages)
    prior_only = np.zeros(html.BUCKETS)

    def run(page: str, known: bool = True) -> str:
        held = learned if known else prior_only
        return html.main_text(page, lambda name: max(-html.CLIP, min(html.CLIP, html.prior(name) + held[html.bucket(name)])))

    return run


PAGES = [
    (LABELLED % "Fish &amp; chips &lt;3", "Head\nFish & chips <3"),
    (LABELLED % "a<br>b  c</p><p> d<b>e</b>f", "Head\na b c\ndef"),
    (LABELLED % "<b>unclosed<br><p>next", "Head\nunclosed\nnext"),
    (LABELLED % "a</p><aside>see also these</aside><script>var x='</p>';</script><ul><li>one <a href='x'>link</a></li><li>two</li></ul><p>z", "Head\na\none link\ntwo\nz"),
    (LABELLED % "a</p><section class='comments'><p>First! I like it a lot</p></section><form><p>Your mail</p><button>Go</button></form><p>z", "Head\na\nz"),
    (LABELLED % "a</p><p hidden>gone</p><div style='display: none'>gone</div><table><tr><td>x</td><td>y</td></tr></table><p>1 < 2 & 3 > 2", "Head\na\nx\ny\n1 < 2 & 3 > 2"),
    ("<body><article><header><h1>T</h1></header><p>text<!-- no > here --> more</p><footer>by me</footer></article>", "T\ntext more"),
    ("<body><div class=cookie-banner>We use cookies</div><div id=content><h2>T</h2><p>one two three</p><p>four</p></div><div class=sidebar><p>Other things to read</p></div></body>", "T\none two three\nfour"),
    ("<form><div><article><p>whole page in a form</p></article></div></form>", "whole page in a form"),
    ("<p title=\"a > b\">text", "text"),
    ("plain text only &eacute; &#233; &nope;", "plain text only é é &nope;"),
    ("<div>one two</div><div>three four</div>", "one two\nthree four"),
    ("<p>cut off <b", "cut off"),
    ("<p>x</p><!-- never closed <p>y</p>", "x"),
    ("", ""),
    ("<script>only()</script>", ""),
    ("< p > <3 a<b", "< p > <3 a"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page_text, page, text):
    assert page_text(page) == text


def test_learned_names_leave_blocks_out(page_text):
    page = "<body><p>first words of it</p><div class='zork'>strange words here again</div><p>last words</p></body>"
    assert page_text(page) == "first words of it\nlast words"
    assert "strange" in page_text("<body><p>first words of it <span class='zork'>strange words</span></p></body>", known=False)


def test_extract_all_rows(spark):
    rows = [(1, "u", LABELLED % "x y z"), (1, "u", LABELLED % "x y z"), (2, None, None), (None, "v", ""), (3, "w", LABELLED % ("long words " * 200_000))]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id or -1, r.url, r.text, r.n_chars) for r in html.extract(pages, html.weights(pages)).collect() if r.url)
    assert got[:3] == [(-1, "v", "", 0), (1, "u", "Head\nx y z", 10), (1, "u", "Head\nx y z", 10)]
    assert got[3][3] == len("Head\n") + len("long words " * 200_000) - 1
    empty = pages.limit(0)
    assert not html.weights(empty).any() and html.extract(empty, html.weights(empty)).count() == 0


def test_nested_and_broken_pages_take_linear_time(page_text):
    deep = "<div>" * 20_000 + "<p>in the middle" + "</div>" * 20_000
    assert page_text(deep) == "in the middle"
    assert page_text('<a b="' * 20_000) == ""


# --- fill in the middle


def brute_fim(key, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", text, None, None
    if h[3] % 100 < 20:
        return key, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return key, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["word", "Ab", " ", "\n", "é", "日", "7", "<", ">", "P", "\x00", "😀"]) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id here"), (None, None), (1002, "a <P> b"), (1003, "x<S>"), (1004, "<M>"), rows[3], rows[3], (1005, "z" * 300_000), (1006, "é" * 300_000)]
    return rows + [(1010 + i, ("long text, with parts 12345 " + "q" * 5000 + " 日本 ") * 700) for i in range(3)]


def test_fim_like_brute_force(spark, texts):
    docs = spark.createDataFrame([(k, t, "f", "o", 3, 4) for k, t in texts], "doc_id long, text string, form string, output string, n long, h1 long").repartition(4)
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[3])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_fim(k, t) for k, t in texts), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_rank_index_is_exact_and_bounded():
    rng = np.random.default_rng(2)
    gaps = np.where(rng.random(60_000) < 0.001, rng.integers(1, 100_000, 60_000), rng.integers(1, 12, 60_000))
    offsets = np.cumsum(gaps)
    index = fim.RankIndex()
    for part in np.split(offsets, [1, 7, 20_000]):
        index.add(part)
    index.close()
    assert (index[np.arange(len(offsets))] == offsets).all()
    assert np.abs(index.residuals.astype(int)).max() <= fim.BOUND and len(index.ranks) < len(offsets) / 50
