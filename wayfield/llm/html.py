"""Main text of web pages: the contiguous region of words and tags with the greatest score.

A page is read once, from left to right. Words score by the elements that they stand in, tags score below zero, and one
linear scan keeps the best region so far (a region is dropped as soon as its sum falls below zero; of equal ones the first
stays). What stands inside the region in a block that is left out (a menu, form, advert, comment section) is not part of the text.

Weights: pages that mark their own article (an ``article`` element) are the labelled ones. Over all of them, words inside and
outside are counted for every element name, class and id above them; a weight is the logarithm of the two shares' ratio, each
counted for ``strength`` words of prior, so rare names stay near zero. A word that a name known as boilerplate explains counts for
that name alone: a list is no worse for standing in a menu. Names are hashed into ``BUCKETS``, so the model does not
grow with the corpus. The names under PLAIN and ASIDE have prior weights, so pages without labels are handled too.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break. Texts of scripts,
styles and the head are never words. An unclosed element ends with the one around it, a paragraph with the next block; an unclosed
comment, script or tag goes to the end of the page. Null and empty pages have an empty text. Repeated rows get equal results,
an empty table gives no row, further columns are ignored. No page is cut: beside a page itself its text nodes take 16 bytes each.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML, and names that sites give to their parts.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noscript script style svg template textarea title".split())
NEUTRAL = frozenset("body div html section span".split())
PLAIN = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
ASIDE_TAGS = frozenset("aside button footer form head header menu nav select".split()) | RAW
ASIDE = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

BUCKETS = 1 << 16
#: Why an element is left out.
FORM, OUT = 1, 2
CLIP = 6.0
PRIOR = 3.0
#: Words in no known element count a little, so that they win only where nothing else does.
FAINT = 0.01
TAG = 0.5

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAMES = re.compile(r"[a-z0-9]+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Texts and tags in order: start, end, tag name (empty for text), whether it closes, attributes."""
    at = text = 0
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?") and after:
            end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            end = end if end >= 4 or (end > 0 and not page.startswith("<!--", at)) else len(page)
            if text < at:
                yield text, at, "", False, ""
            at = text = max(end, at + 1)
            continue
        found = _TAG.match(page, at) or _CUT.match(page, at)
        if not found:
            at += 1
            continue
        if text < at:
            yield text, at, "", False, ""
        name, closes = found[2].lower(), bool(found[1])
        yield at, found.end(), name, closes, found[3]
        at = text = found.end()
        if name in RAW and not closes and not found[3].endswith("/"):
            close = _CLOSE[name].search(page, at)
            at = text = close.start() if close else len(page)
    if text < len(page):
        yield text, len(page), "", False, ""


def names_of(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """An element's names (tag, then classes, ids and role), and whether it is hidden."""
    names, hidden = [tag], False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            names += [f".{x}" for x in _NAMES.findall(value)]
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none", value) is not None
        else:
            hidden |= key == "hidden" or value == "true"
    return tuple(dict.fromkeys(names)), hidden


def aside(names: tuple[str, ...]) -> bool:
    """Is one of the names known as boilerplate?"""
    return names[0] in ASIDE_TAGS or any(x[1:] in ASIDE for x in names[1:])


def prior(name: str) -> float:
    if name in PLAIN or name == ".main":
        return PRIOR
    return -PRIOR if name in ASIDE_TAGS or (name[0] == "." and name[1:] in ASIDE) else 0.0


class Element:
    """An open element: the names on the way to it, their weight, whether it is left out, and whether around a left-out part is content."""

    __slots__ = ("tag", "names", "total", "out", "inside", "hole")

    def __init__(self, tag: str = "", names: frozenset[str] = frozenset(), total: float = 0.0, out: int = 0, inside: bool = False, hole: bool = False):
        self.tag, self.names, self.total, self.out, self.inside, self.hole = tag, names, total, out, inside, hole


class Reader:
    """Open elements while a page is read."""

    def __init__(self, weight) -> None:
        self.weight, self.stack, self.open, self.known = weight, [Element()], Counter(), {}

    def _pop(self, until: int) -> None:
        for element in self.stack[until:]:
            self.open[element.tag] -= 1
        del self.stack[until:]

    def _end(self, tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._pop(i)
                return
            if self.stack[i].tag in stop:
                return

    def tag(self, tag: str, closes: bool, attributes: str) -> None:
        if closes:
            self._end((tag,), frozenset() if tag in BLOCKS else BLOCKS)
            return
        if tag in ENDS_P and self.open["p"]:
            self._end(("p",), frozenset({"article", "main", "table", "td", "th", "button"}))
        if tag in SIBLINGS:
            self._end(tuple(SIBLINGS[tag].split()), frozenset({"ul", "ol", "table", "dl", "select"}))
        if tag in VOID or attributes.endswith("/"):
            return
        above = self.stack[-1]
        if (key := (tag, attributes)) not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[key] = names_of(tag, attributes)
        names, hidden = self.known[key]
        if tag == "header" and above.inside:
            names = ()  # the heading of the article itself
        new = [x for x in names if x not in NEUTRAL and x not in above.names]
        own = sum(self.weight(x) for x in new)
        starts = tag in ("article", "main")
        out = OUT if hidden or (names and not starts and (aside(names) or own < 0)) else 0
        if out and tag == "form" and not hidden and len(names) == 1:
            out = FORM
        # a form may wrap a whole page: an article inside starts afresh
        if starts and above.out == FORM:
            above = Element()
        hole = above.hole or (out > 0 and above.total > 0 and not above.out)
        self.stack.append(Element(tag, above.names.union(new) if new else above.names, above.total + own, max(above.out, out), above.inside or starts, hole))
        self.open[tag] += 1


def counts(page: str) -> tuple[Counter, Counter]:
    """Words by name, inside and outside of a labelled page's article; the empty name counts all of them."""
    reader, found = Reader(prior), (Counter(), Counter())
    for start, end, tag, closes, attributes in tokens(page):
        if tag:
            reader.tag(tag, closes, attributes)
            continue
        if not (n := len(page[start:end].split())):
            continue
        element = reader.stack[-1]
        names = element.names
        side = found[0 if element.inside and not element.out else 1]
        if element.out:
            names = [x for x in names if prior(x) < 0]
        side[""] += n
        for name in names:
            side[name] += n
    return found


def _region(page: str, weight, faint: float) -> tuple[str, bool]:
    """The text of the best region, and whether any word has a weight of more than ``faint``."""
    reader = Reader(weight)
    begins, ends, blocks = array("q"), array("q"), array("q")
    block, known = 0, False
    total, start, best, first, last = 0.0, 0, 0.0, 0, 0
    for begin, end, tag, closes, attributes in tokens(page):
        if tag:
            reader.tag(tag, closes, attributes)
            block += tag in BLOCKS
            total -= TAG
            if tag == "br" and not reader.stack[-1].out:
                begins.append(begin), ends.append(begin), blocks.append(block)
        else:
            element, words = reader.stack[-1], len(page[begin:end].split())
            if not element.out:
                begins.append(begin), ends.append(end), blocks.append(block)
                known |= words > 0 and element.total > faint
                total += words * max(element.total, faint)
            elif not element.hole:
                total += words * min(element.total, -faint)
        if total <= 0:
            total, start = 0.0, end
        elif total > best:
            best, first, last = total, start, end
    lines, parts, current = [], [], -1

    def line() -> None:
        if text := " ".join("".join(parts).split()):
            lines.append(text)
        parts.clear()

    for begin, end, at in zip(begins, ends, blocks, strict=True):
        if begin >= first and end <= last and best:
            if at != current:
                line()
                current = at
            parts.append(html.unescape(page[begin:end]) if end > begin else " ")
    line()
    return "\n".join(lines), known


def main_text(page: str, weight) -> str:
    """The text of the best region of one page; where no word stands in an element with a weight, all words count alike."""
    text, known = _region(page, weight, FAINT)
    return text if known else _region(page, weight, 1.0)[0]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def weights(pages: DataFrame, column: str = "html", strength: int = 50) -> np.ndarray:
    """The learned part of every bucket's weight, from all pages that mark an article; zeros where none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for page in batch.column(0):
                for side, found in zip(held, counts(page.as_py()), strict=True):
                    for name, n in found.items():
                        side[bucket(name) if name else BUCKETS] += n
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], names=["bucket", "inside", "outside"])

    labelled = pages.select(F.col(column).cast("string").alias("page")).filter(F.col("page").rlike(r"(?i)<article[\s>]"))
    sums = labelled.mapInArrow(run, "bucket long, inside long, outside long").groupBy("bucket").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    # a row per bucket at most
    rows = sums.toArrow()
    held = np.zeros((2, BUCKETS + 1))
    for i in (0, 1):
        held[i, rows.column(0).to_numpy()] = rows.column(i + 1).to_numpy()
    every = held[:, BUCKETS]
    if not every.all():
        return np.zeros(BUCKETS)
    least = strength / every.sum()
    return np.log((held[0, :BUCKETS] / every[0] + least) / (held[1, :BUCKETS] / every[1] + least))


def extract(pages: DataFrame, learned: np.ndarray, id_col: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weight(name: str) -> float:
            if name not in known:
                if len(known) > BUCKETS:
                    known.clear()
                known[name] = max(-CLIP, min(CLIP, prior(name) + float(learned[bucket(name)])))
            return known[name]

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, begin, size = [], at, 0
                while at < batch.num_rows and size < 1 << 22:
                    texts.append(main_text(batch.column(2)[at].as_py() or "", weight))
                    size += len(texts[-1])
                    at += 1
                rows = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[id_col, "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url).cast("string").alias("url"), F.col(column).cast("string").alias("page"))
    return rows.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
