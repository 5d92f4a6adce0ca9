"""WARC archives with a two-level capture index.

**Writing.** Each task writes its pages as gzip members, one record each, into archive files of the
shared folder, and returns where every record lies. Pages with equal payloads have one ``response``
record, the others are ``revisit`` records that name it and carry no payload.

**Index.** Records are sorted by the reversed host and path of their URL, then page. Every run of
``BLOCK`` entries is compressed into a block; a shard (one task's range of keys) is one file of
blocks. The sparse directory at its end has one line per block: first key, place, length. A lookup finds the
shard among the first keys of all shards (one per shuffle partition, so their number follows the
cluster, not the data), the block by binary search in the shard's directory, and the entries by
binary search in the block; only then is the record's byte range read.

A retried task writes new files under another name; the index names only those of the task that
counted, so lost executors leave no wrong entries.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared_files import filesystem, new_folder
from thicket.session import stage

#: Entries of an index block.
BLOCK = 256
#: Bytes after which a task starts another archive file.
ARCHIVE_BYTES = 1 << 30
LEVEL = 5
#: Open archive files that a reading task keeps.
OPEN_FILES = 64

RECORD = (
    "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
    "WARC-Payload-Digest: sha1:{digest}\r\nX-Page-ID: {page}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {length}\r\n\r\n"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where a written archive lies: the table of index shards with their directories."""

    shards: DataFrame


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``com,example,www)/a?b``; an absent URL has the key ``-``."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "#.*$", ""), r"\s", "%20")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@|:\d+$", ""))
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?]*", ""), "^$", "/")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit("-"))


def capture_key(url: Column, page: Column) -> Column:
    """Key of one capture; sorts by URL key, then page."""
    return F.concat_ws(" ", url_key(url), F.coalesce(F.lpad(page.cast("string"), 20, "0"), F.lit("-")))


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, date: str) -> bytes:
    digest = base32_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers}>\r\n" if revisit else ""
    body = http if revisit else http + payload
    safe = "".join(c if c > " " else "%20" for c in url or "-")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {safe} {digest}")
    head = RECORD.format(kind="revisit" if revisit else "response", uuid=name, url=safe, date=date, digest=digest, page="-" if page is None else page, more=more, length=len(body))
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of one compressed record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> Archive:
    """Write one record per row and index them.

    The payload is the html in UTF-8; null is empty. Of equal payloads of at least ``min_bytes``
    bytes the smallest id is the ``response`` and rows with other ids are ``revisit``; smaller
    payloads are all ``response``. Repeated rows and rows that share an id are records of their own.
    A row without id is a record without page; it can only revisit. A null URL has the key ``-``.
    Other columns are ignored. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("html")))
    enough = F.octet_length("html") >= min_bytes
    first = rows.where(enough).select("page", F.unhex(F.sha1("html")).alias("digest")).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 AND first IS NOT NULL").select("digest", "first").hint("shuffle_hash")
    marked = keyed.join(first, "digest", "left").withColumn("revisit", enough & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")))
    marked = marked.select("page", "url", "html", "first", "revisit", capture_key(F.col("url"), F.col("page")).alias("key"))
    folder = new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            entries = []
            for start in range(0, len(batch), 256):
                for r in batch.slice(start, 256).to_pylist():
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    member = _record(r["page"], r["url"], r["html"].encode(), r["first"], r["revisit"], date)
                    out.write(member)
                    entries.append((r["key"], name, at, len(member)))
                    at += len(member)
            yield pa.record_batch([pa.array(c) for c in zip(*entries, strict=True)], names=["key", "file", "start", "size"])
        if out is not None:
            out.close()

    entries = stage(marked.mapInArrow(write, "key string, file string, start long, size long"))
    return Archive(stage(_index(entries, folder)))


def _index(entries: DataFrame, folder: str) -> DataFrame:
    """Sort entries into shards of compressed blocks; one row per shard with its range and the place of its directory."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        name, out, at, held, directory, last = f"{uuid.uuid4().hex}.cdx", None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(held).encode())
            directory.append((held[0].split("\t", 1)[0], at, len(data)))
            out.write(data)
            at, held = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                held.append(f"{r['key']}\t{r['file']}\t{r['start']}\t{r['size']}")
                last = r["key"]
                if len(held) == BLOCK:
                    flush()
        if held:
            flush()
        if out is not None:
            sparse = zlib.compress("\n".join(f"{k}\t{a}\t{n}" for k, a, n in directory).encode())
            out.write(sparse)
            out.close()
            yield pa.record_batch([pa.array([x]) for x in (f"{folder}/{name}", directory[0][0], last, at, len(sparse))], names=["shard", "low", "high", "start", "size"])

    ordered = entries.repartitionByRange("key", "file", "start").sortWithinPartitions("key", "file", "start")
    return ordered.mapInArrow(compress, "shard string, low string, high string, start long, size long")


class _Reader:
    """Range reads with a few files kept open."""

    def __init__(self):
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, uri: str, start: int, size: int) -> bytes:
        if uri not in self.open:
            system, path = filesystem(uri)
            self.open[uri] = system.open_input_file(path)
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return self.open[uri].read_at(size, start)


def lookup(archive: Archive, wanted: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Records whose capture key lies between ``low`` and ``high``, both included, for every distinct pair.

    Returns ``key``, ``page``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``,
    ``payload_digest`` (of the full payload) and ``payload`` (empty for revisits). A key that
    several records share gives them all; a key that is not there gives none; nulls find nothing.
    """
    spark = wanted.sparkSession
    # one row per shuffle partition that held entries: bounded by the cluster's setting
    bounds = sorted(tuple(r) for r in archive.shards.select("low", "high", "shard", "start", "size").collect())
    sent = spark.sparkContext.broadcast(bounds)
    asked = wanted.select(F.col(low).alias("a"), F.col(high).alias("b")).where("a <= b").distinct()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = sent.value
        lows, highs = [x[0] for x in shards], [x[1] for x in shards]
        for batch in batches:
            a, b, shard = [], [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(bisect_left(highs, x), bisect_right(lows, y)):
                    a.append(x), b.append(y), shard.append(shards[i][2])
            yield pa.record_batch([pa.array(c, pa.string()) for c in (a, b, shard)], names=["a", "b", "shard"])

    placed = asked.mapInArrow(assign, "a string, b string, shard string")
    placed = placed.repartition("shard").sortWithinPartitions("shard", "a")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, entries = _Reader(), None, []
        shard, first = None, []
        directory = {x[2]: x[3:] for x in sent.value}
        for batch in batches:
            for at in range(0, len(batch), 128):
                found = []
                part = batch.slice(at, 128)
                for name, a, b in zip(*(part.column(c).to_pylist() for c in ("shard", "a", "b")), strict=True):
                    if name != shard:
                        shard, current = name, None
                        lines = [line.split("\t") for line in zlib.decompress(reader.read(shard, *directory[shard])).decode().split("\n")]
                        first, start, size = [x[0] for x in lines], [int(x[1]) for x in lines], [int(x[2]) for x in lines]
                    block = max(bisect_left(first, a) - 1, 0)
                    while block < len(first) and first[block] <= b:
                        if current != block:
                            lines = zlib.decompress(reader.read(shard, start[block], size[block])).decode().split("\n")
                            entries, current = [line.split("\t") for line in lines], block
                            keys = [e[0] for e in entries]
                        found += entries[bisect_left(keys, a) : bisect_right(keys, b)]
                        block += 1
                rows = []
                for key, file, offset, length in found:
                    r = parse(reader.read(f"{shard.rpartition('/')[0]}/{file}", int(offset), int(length)))
                    refers = r.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    full = r["http"]["Content-Length"]
                    rows.append((key, None if r["X-Page-ID"] == "-" else int(r["X-Page-ID"]), r["WARC-Target-URI"], r["WARC-Type"], int(refers) if refers else None, int(full), r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload"]))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["key", "page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
                yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return placed.mapInArrow(fetch, "key string, page long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def lookup_captures(archive: Archive, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of given pages, found by URL and id."""
    key = capture_key(F.col(url_col), F.col(id_col))
    return lookup(archive, pages.select(key.alias("low"), key.alias("high")))


def lookup_urls(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures of given URLs; a null URL stands for records without one."""
    key = url_key(F.col(url_col))
    return lookup(archive, urls.select(F.concat(key, F.lit(" ")).alias("low"), F.concat(key, F.lit(" ~")).alias("high")))
