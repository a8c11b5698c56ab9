"""Token counts by section: a document is encoded once, as a whole, and its tokens are dealt to its sections by offsets.

A document is its fields joined by line breaks; sections are the fields, the last of them (the text) cut at line breaks.
A byte-level vocabulary gives every token its bytes, so the running sum of lengths is the offset of each token, and the
interval join of token spans with sections is a search in two sorted arrays. A separator belongs to the section before it.

A token that crosses a boundary counts once, by ``rule``: "first" (the section of its first byte), "last" (of its last
byte), or "most" (the section with most of its bytes, the earlier of equals). Section counts add up to the document's.

Null fields are empty. A document has a section for every field, empty ones too; of a document of empty fields the separators
are the only tokens. Repeated rows get equal results. Texts over ``PIECE`` characters are encoded in pieces that begin where
the vocabulary's own splitting begins a token as well, at a space before a letter or, where there is none, at a change
between letters, digits and marks, so tokens are the same. Only a run of more than ``PIECE`` characters of one kind is cut hard.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.text import utf8

PIECE = 1 << 18
#: Fixed value: how byte-level vocabularies of this kind split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The encoder, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _kind(c: str) -> str:
    kind = unicodedata.category(c)[0]
    return " " if c.isspace() else kind if kind in "LN" else "-"


def _changes(text: str, at: int) -> bool:
    """Does a token begin here because letters, digits or marks end? An apostrophe may belong to what follows it."""
    before, after = _kind(text[at - 1]), _kind(text[at])
    return before != after and " " not in (before, after) and text[at - 1] != "'"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        back, ahead = range(at + size, at + size // 2, -1), range(at + size, min(at + 2 * size, len(text)))
        end = next((i for i in back if text[i] == " " and text[i + 1 : i + 2].isalpha() and not text[i - 1].isspace()), None)
        end = end or next((i for i in back if _changes(text, i)), None) or next((i for i in ahead if _changes(text, i)), at + size)
        yield text[at:end]
        at = end
    yield text[at:]


def deal(lengths: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (their lengths in bytes) dealt to sections (their first bytes): a count for each section."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    to = last if rule == "last" else first.copy()
    if rule == "most":
        limit = np.append(starts[1:], max(int(ends[-1]) if len(ends) else 0, int(starts[-1])))
        for i in np.flatnonzero(first != last):
            sections = np.arange(first[i], last[i] + 1)
            share = np.minimum(limit[sections], ends[i]) - np.maximum(starts[sections], begins[i])
            to[i] = sections[np.argmax(share)]
    return np.bincount(to, minlength=len(starts))


def section_tokens(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "most", vocabulary_path: str | None = None) -> DataFrame:
    """One row per document and section: id, field, section, n_bytes, n_tokens, and the document's doc_tokens."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    path = vocabulary_path or default_vocabulary()
    names = [id_col, "field", "section", "n_bytes", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = vocabulary(path)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                columns = [utf8(batch.column(i + 1)) for i in range(len(fields))]
                row, field, section, nbytes, counts, totals = [], [], [], [], [], []
                for i in range(batch.num_rows):
                    parts = [data[offsets[i] : offsets[i + 1]] for data, offsets in columns]
                    begin = np.cumsum([0] + [len(p) + 1 for p in parts])
                    lines = begin[-2] + np.flatnonzero(parts[-1] == 10) + 1
                    lines = lines[lines < begin[-1] - 1]
                    starts = np.concatenate([begin[:-1], lines]).astype(np.int64)
                    text = b"\n".join(p.tobytes() for p in parts)
                    ids = [t for piece in pieces(text.decode("utf-8", "replace")) for t in encoder.encode_ordinary(piece)]
                    dealt = deal(sizes[np.array(ids, dtype=np.int64)], starts, rule)
                    row.append(np.full(len(starts), i))
                    field.append(np.minimum(np.arange(len(starts)), len(fields) - 1))
                    section.append(np.maximum(np.arange(len(starts)) - len(fields) + 1, 0))
                    nbytes.append(np.diff(np.append(starts, len(text))))
                    counts.append(dealt)
                    totals.append(np.full(len(starts), len(ids)))
                take = pa.array(np.concatenate(row)) if row else pa.array([], type=pa.int64())
                values = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (field, section, nbytes, counts, totals)]
                named = pa.array(list(fields)).take(pa.array(values[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), named, *(pa.array(v) for v in values[1:])], names=names)

    chosen = docs.select(F.col(id_col), *(F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields)))
    return chosen.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, field string, section long, n_bytes long, n_tokens long, doc_tokens long")
