"""WARC archives with a two-level capture index.

Pages are written as WARC records, each its own gzip member, so any record can be read from
its offset alone.  The index holds one line per capture, sorted by the URL's key with its host
reversed, in compressed blocks; each part of the index ends with a sparse directory of its blocks, and
the table of parts is the directory above.  A lookup searches the parts, then a part's directory,
and then reads only the blocks, and from the archives only the records, that it needs.

Files are written by tasks into the shared folder under names of their own.  The tables of
entries and parts name the files of the attempts that succeeded, so files left behind by lost or
repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import shared_folder, stage

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 2048
LEAST_SHARED = 1000

ENTRY = "key string, page_id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """The URL with its host reversed: ``http://www.a.org/x?y#z`` gives ``org,a,www)/x?y``; null gives ``)``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"[\x00-\x20\x7f]", "%20"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and ":" in folder.split("/")[0]:
        folder = folder.split(":", 1)[0] + "://" + folder.split(":", 1)[1]
    return fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to page_id and url.

    Of records with equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest page_id is the
    response and the others revisit it.  The digest is joined to the pages, so the payloads are shuffled
    once; a payload that many pages share is split by the join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = (
        rows.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").drop("n")
    )
    again = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"),
    )


def record(row: dict, captured: str) -> bytes:
    """One WARC record.  A revisit keeps the HTTP header, with the payload's length, and drops the payload."""
    name = "none" if row["page_id"] is None else row["page_id"]
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = http + (row["payload"] or "").encode()
    url = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"])
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {captured}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; the payload of a response is digested anew."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")

    def number(name: str) -> int | None:
        value = fields.get(name, "none>").rsplit(":", 1)[-1].rstrip(">")
        return None if value == "none" else int(value)

    sizes = [line.split(": ", 1)[1] for line in http.decode().split("\r\n") if line.lower().startswith("content-length")]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":", 1)[1]).hex()
    response = fields["WARC-Type"] == "response"
    if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(sizes[0])):
        raise ValueError("payload and header of a record differ")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "payload": payload.decode() if response else None,
        "payload_bytes": len(payload) if response else int(sizes[0]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if not response else None,
    }


def write_archives(classified: DataFrame, folder: str, captured: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the records and return the staged table of captures: key, page_id, file, offset, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out, file = None, None
        try:
            for batch in batches:
                entries = []
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        file = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(file, compression=None)
                    at = out.tell()
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(pack.compress(record(row, captured)) + pack.flush())
                    entries.append((row["key"], row["page_id"], file, at, out.tell() - at))
                    if out.tell() > ARCHIVE_BYTES:
                        out.close()
                        out = None
                if entries:
                    yield _entries(entries)
        finally:
            if out is not None:
                out.close()

    rows = classified.withColumn("key", url_key(F.col("url")))
    return stage(rows.mapInArrow(write, ENTRY), "captures")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["key", "page_id", "file", "offset", "length"]
    )


@dataclass(frozen=True)
class Part:
    first: str
    last: str
    file: str
    directory: tuple  # offset and length of its block directory


def write_index(captures: DataFrame, folder: str) -> list[Part]:
    """Write the sorted index; the list of its parts has one entry per index file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out, lines, blocks, keys, file = None, [], [], [], None

        def flush() -> None:
            packed = zlib.compress("\n".join("\t".join(x) for x in lines).encode(), 6)
            blocks.append([lines[0][0], out.tell(), len(packed)])
            out.write(packed)
            keys.append(lines[-1][0])
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    file = f"{root}/{uuid.uuid4().hex}.index"
                    out = store.open_output_stream(file, compression=None)
                lines.append((r["key"], "" if r["page_id"] is None else str(r["page_id"]), r["file"], str(r["offset"]), str(r["length"])))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(blocks).encode(), 6)
            at = out.tell()
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (blocks[0][0], keys[-1], file, at, len(packed))], ["first", "last", "file", "offset", "length"]
            )

    width = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.repartitionByRange(width, "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    parts = stage(placed.mapInArrow(write, "first string, last string, file string, offset long, length long"), "index-parts")
    # one row per index file, that is per partition of the sort
    return [Part(r["first"], r["last"], r["file"], (r["offset"], r["length"])) for r in parts.orderBy("first", "last").collect()]


def _read(folder: str):
    """A function that reads byte ranges; the file read last stays open."""
    store, _ = _open(folder)
    kept: dict = {}

    def read(file: str, offset: int, length: int) -> bytes:
        if file not in kept:
            for old in kept.values():
                old.close()
            kept.clear()
            kept[file] = store.open_input_file(file)
        kept[file].seek(offset)
        return kept[file].read(length)

    return read


def lookup(keys: DataFrame, parts: list[Part], folder: str) -> DataFrame:
    """Captures of URL keys (column ``key``): key, page_id, file, offset, length.

    Each key is searched for in the parts and then in the directories of those that may hold it.  The blocks found are
    dealt out, so a key with very many captures is read by many tasks, and each block is read once.
    """
    sent = keys.sparkSession.sparkContext.broadcast(parts)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, read = sent.value, _read(folder)
        firsts, lasts = [p.first for p in table], [p.last for p in table]
        known: dict[int, list] = {}
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    if i not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[i] = json.loads(zlib.decompress(read(table[i].file, *table[i].directory)))
                    blocks = known[i]
                    starts = [b[0] for b in blocks]
                    for j in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                        out.append((table[i].file, blocks[j][1], blocks[j][2], key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["file", "offset", "length", "key"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, block, wanted = _read(folder), None, set()

        def found() -> Iterator[pa.RecordBatch]:
            if block is None:
                return
            lines = (line.split("\t") for line in zlib.decompress(read(*block)).decode().split("\n"))
            rows = [(k, int(p) if p else None, f, int(o), int(n)) for k, p, f, o, n in lines if k in wanted]
            if rows:
                yield _entries(rows)

        for batch in batches:
            for file, offset, length, key in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key"))):
                if block != (file, offset, length):
                    yield from found()
                    block, wanted = (file, offset, length), set()
                wanted.add(key)
        yield from found()

    sorted_keys = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = sorted_keys.mapInArrow(locate, "file string, offset long, length long, key string")
    return blocks.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(scan, ENTRY)


def fetch(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records of captures by their byte ranges, in file order."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(folder)
        for batch in batches:
            rows = [
                parse(zlib.decompress(read(f, o, n), 31))
                for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))
            ]
            kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.string(), "payload_bytes": pa.int64(),
                     "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] if payloads or k != "payload" else None for r in rows], t) for k, t in kinds.items()], list(kinds)
            )

    placed = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(
        load, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_and_read(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write pages to archives, index them, look every page's URL up and read its records back.

    ``pages``: page_id, url, html; other columns are ignored.  Returns one row per input row: page_id, url,
    payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url is the empty one, and rows with a null page_id are responses unless
    a row with an id has the same payload.  If several rows have the largest page_id of a group of equal payloads,
    all of them are responses.  Pages with the same URL are all found under its key.  Empty tables give an empty result.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(revisits(pages), folder)
    parts = write_index(captures, folder)
    return fetch(lookup(pages.select(url_key(F.col("url")).alias("key")), parts, folder), folder, payloads)
