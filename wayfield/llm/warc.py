"""WARC archives of pages: one gzip member per record, written by tasks into the shared folder and read back as streams.

Writing: of rows with equal payloads (SHA-256) of at least ``least`` bytes, the one with the smallest id is a response and
the others are revisits that refer to it; smaller payloads are always responses. A task rolls to a new archive after
``archive_bytes``. Archives get a name of their own per attempt and are listed in a manifest table, which a repeated task
cannot enter twice; files that are not listed are not read.

Reading: an archive is read in sequence, in pieces of 1 MB. Each gzip member is decompressed as it comes, its header lines
are parsed, its block is framed by Content-Length and hashed piece by piece; a wrong length, a missing end, an empty or cut
member, or a digest that differs raises an error. No record is held whole unless payloads are asked for.

Null payloads are empty ones. A null id is the empty id: it never is the one referred to where others exist. Repeated rows
of the smallest id are each a response. A null url is written as the record's own id. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import DataType

from wayfield.llm.store import fresh, open_store, written

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

MANIFEST = "archive string, records long, bytes long"
RECORD = "archive string, type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long"
PIECE = 1 << 20
TASK_BYTES = 256 << 20


def record(kind: str, fields: dict[str, str], parts: list[bytes]) -> bytes:
    """One record as a gzip member of its own."""
    block = hashlib.sha256()
    for part in parts:
        block.update(part)
    lines = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha256:{block.hexdigest()}", "Content-Length": str(sum(map(len, parts)))}
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([squeeze.compress(head), *(squeeze.compress(p) for p in parts), squeeze.compress(END), squeeze.flush()])


def _name(key: str | None) -> str:
    return f"<urn:page:{urllib.parse.quote(key or '', safe='')}>"


def _page(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    own = _name(row["key"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = own[1:-1] if row["url"] is None else urllib.parse.quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]")
    fields = {"WARC-Record-ID": own, "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{row['digest']}"}
    if row["first"] is None:
        return record("response", fields, [http, payload])
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(row["first"])}, [http])


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        out, name, records, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, [b"format: WARC File Format 1.1\r\n"])
                    size = out.write(info)
                member = _page(row, date)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    return run


class Member:
    """One record of an open archive: its header fields, then its block in pieces."""

    def __init__(self, stream: Stream):
        self.stream, self.inflate, self.ready = stream, zlib.decompressobj(31), b""
        head = b""
        while END not in head:
            piece = self.more()
            if not piece:
                raise ValueError("a record ends inside its header")
            head += piece
        head, _, self.ready = head.partition(END)
        lines = head.split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}

    def more(self) -> bytes:
        """Some more of the record; empty at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.decompress(self.inflate.unconsumed_tail or self.stream.read(), PIECE)
            if self.inflate.eof:
                self.stream.back(self.inflate.unused_data)
            if data:
                return data
        return b""

    def block(self) -> Iterator[bytes]:
        left, digest = int(self.fields["content-length"]), hashlib.sha256()
        while left:
            piece = self.ready or self.more()
            if not piece:
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.ready = piece[:left], piece[left:]
            left -= len(piece)
            digest.update(piece)
            yield piece
        tail = self.ready
        while piece := self.more():
            tail += piece
            if len(tail) > len(END):
                break
        if tail != END:
            raise ValueError("a record is longer than its Content-Length")
        if self.fields.get("warc-block-digest", "") != f"sha256:{digest.hexdigest()}":
            raise ValueError(f"block digest differs in {self.fields.get('warc-record-id')}")


class Stream:
    """An archive's bytes in sequence; what a member did not use goes back."""

    def __init__(self, source):
        self.source, self.spare = source, b""

    def read(self) -> bytes:
        data, self.spare = self.spare or self.source.read(PIECE), b""
        if not data:
            raise ValueError("an archive ends inside a record")
        return data

    def back(self, data: bytes) -> None:
        self.spare = data

    def __iter__(self) -> Iterator[Member]:
        while self.spare or (data := self.source.read(PIECE)):
            self.spare = self.spare or data
            yield Member(self)


def _payload(member: Member, keep: bool) -> tuple[str | None, int, list[bytes]]:
    """Digest, length and (if kept) pieces of the payload behind the HTTP header; checked against the record's fields."""
    head, digest, size, pieces = b"", hashlib.sha256(), -1, []
    for piece in member.block():
        if size < 0:
            head += piece
            if END not in head:
                continue
            head, _, piece = head.partition(END)
            size = 0
        digest.update(piece)
        size += len(piece)
        if keep:
            pieces.append(piece)
    told = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    length, stated = int(told.get(b"content-length", b"0")), member.fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if member.fields["warc-type"] == "revisit":
        return stated, length, pieces
    if digest.hexdigest() != stated or size != length:
        raise ValueError(f"payload digest or length differs in {member.fields.get('warc-record-id')}")
    return stated, size, pieces


def _reader(folder: str, payloads: bool):
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in (RECORD + ", payload binary" * payloads).split(", "))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        for batch in batches:
            for archive, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{archive}", compression=None) as source:
                    for member in Stream(source):
                        f = member.fields
                        if f["warc-type"] not in ("response", "revisit"):
                            for _ in member.block():
                                pass
                            continue
                        digest, size, pieces = _payload(member, payloads)
                        rows.append((archive, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest, size) + ((b"".join(pieces),) if payloads else ()))
                        held, seen = held + (size if payloads else 200), seen + 1
                        if held > 4 * PIECE:
                            yield packed(rows)
                            rows, held = [], 0
                if seen != stated:
                    raise ValueError(f"{archive} holds {seen} records, the manifest says {stated}")
                if rows:
                    yield packed(rows)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record; returns the manifest: archive, records, bytes."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    # only payloads that stand twice; written, so that Spark can split a payload that very many pages share
    firsts = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = written(firsts.filter("times > 1").select(F.col("digest").alias("digest_f"), "first"), "firsts")
    # small payloads, empty ones above all, refer to nothing and are spread by their ids
    rows = rows.withColumn("k", F.when(F.col("n") >= least, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("id", "url").cast("string"))))
    named = rows.join(firsts, F.expr("k = digest_f"), "left").withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    records = named.select(F.col("id").cast("string").alias("key"), "url", "payload", "digest", F.col("first").cast("string").alias("first"))
    return written(records.mapInArrow(_writer(folder, archive_bytes, date), MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record of the listed archives, with the payload if asked for.

    Archives are dealt out evenly, to a task each, or to tasks of ``TASK_BYTES`` where there are more archives than cores.
    """
    archives, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(archives, manifest.sparkSession.sparkContext.defaultParallelism), min(archives, -(-size // TASK_BYTES)))
    # a number given is kept: adaptive execution would merge the short manifest into one task
    spread = manifest.select("archive", "records").repartitionByRange(tasks, "archive")
    return spread.mapInArrow(_reader(folder, payloads), RECORD + ", payload binary" * payloads)


def page_id(name: str, kind: DataType) -> Column:
    """The id inside a record name, in its own type; null where there is none."""
    key = F.url_decode(F.regexp_extract(F.col(name), "^<urn:page:(.*)>$", 1))
    return F.when(key != "", key).cast(kind)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """Write all pages to a new folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = fresh(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    back = read_archives(write_archives(pages, folder, id_col, url, payload, least), folder)
    return back.select(page_id("record_id", kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_id("refers_to", kind).alias("refers_to"), "archive")
