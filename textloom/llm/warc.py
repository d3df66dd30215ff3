"""WARC archives: a writer and a salvage reader.

Writer: each task writes archives of one gzip member a record and starts the next at ``roll_bytes``. Of
records with equal payloads the one with the smallest page_id is a response; others are revisit records
that refer to it and carry its digest but no payload. A manifest holds the archives of committed tasks
only: an attempt that is lost with its executor leaves a file that no manifest names.

Salvage reader: takes member after member (or, in a plain archive, record after record). Each must pass
its checks: gzip CRC and length, version line, header fields, Content-Length, the closing line ends, the
SHA-1 digests of block and payload where they are given. After a failed check it searches byte by byte for the next
member or version line at which a whole record passes, goes on there, and logs the bytes between as a
quarantined gap with the first failed check as reason. Of a gzip member that holds several records each is checked by itself: a bad
one does not cost the others, and of a member that ends too soon or fails its own check the records stay whose block digest
is right; the member is then logged as a gap too. Files are read in pieces, whatever their size; a member is held whole.

Scale: pages are joined by payload digest to the digests that occur more than once (pre-aggregated and
written, so that AQE can split a hot digest or broadcast a small table). One task reads one archive.

Cases: a null html is an empty payload, and empty payloads are equal like others. A null url is left
out; line ends in a url are percent-encoded. Rows that tie on the smallest page_id of a payload are all
responses. A null page_id sorts last and is written without one; if all of a payload's ids are null, all
are responses. A very long url is a long header and read whole; of a revisit without a payload length of digits the length is null. An empty
table gives no archive and an empty result. Other columns of the pages are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import Scratch

ROLL_BYTES = 32_000_000
_PIECE = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 1 << 16
READ_SCHEMA = (
    "archive string, offset long, bytes long, reason string, record_type string, page_id long, uri string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit of that page."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", "2000-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into ``folder``; the manifest: archive, records, bytes."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    repeated = scratch.keep(repeated, "repeated")
    rows = rows.join(repeated, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, count, path = None, 0, 0, ""
        fs, base = _folder(folder)
        fs.create_dir(base, recursive=True)
        for frame in frames:
            for page_id, url, html, refers in zip(frame["page_id"].astype("Int64"), frame["url"], frame["html"], frame["refers_to"].astype("Int64"), strict=True):
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = member(record(None if page_id is pd.NA else page_id, url, html.encode("utf-8", "surrogatepass"), None if refers is pd.NA else refers))
                out.write(data)
                size += len(data)
                count += 1
                if size >= roll_bytes:
                    out.close()
                    yield pd.DataFrame({"archive": [path], "records": [count], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [path], "records": [count], "bytes": [size]})

    return scratch.keep(rows.mapInPandas(run, "archive string, records long, bytes long"), "manifest")


class Source:
    """A seekable file read in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(_PIECE, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            piece = self.read(at, _PIECE + len(what) - 1)
            k = piece.find(what)
            if k >= 0:
                return at + k
            at += _PIECE
        return -1


class Bad(Exception):
    """A failed check."""


def _parse(read, size: int, at: int) -> tuple[dict[str, str], int, int]:
    """Header fields, start of the block and end of the record at ``at`` of something with ``read``."""
    head = read(at, _HEAD)
    if not _VERSION.match(head):
        raise Bad("version line")
    while (end := head.find(b"\r\n\r\n")) < 0:
        # a header may be long, but every whole line of it is a field
        if at + len(head) >= size or any(b":" not in line for line in head.split(b"\r\n")[1:-1]):
            raise Bad("header")
        head = read(at, 2 * len(head))
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        raise Bad("header")
    block = at + end + 4
    stop = block + int(fields["content-length"])
    if stop + 4 > size:
        raise Bad("truncated")
    if read(stop, 4) != b"\r\n\r\n":
        raise Bad("content length")
    return fields, block, stop + 4


def _checked(fields: dict[str, str], block: bytes) -> bytes:
    """The payload, once the digests are right."""
    given = fields.get("warc-block-digest", "")
    if given.startswith("sha1:") and given[5:] != sha1_32(block):
        raise Bad("block digest")
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not (fields.get("content-type", "").startswith("application/http") and gap):
        payload = block
    given = fields.get("warc-payload-digest", "")
    if fields["warc-type"] != "revisit" and given.startswith("sha1:") and given[5:] != sha1_32(payload):
        raise Bad("payload digest")
    return payload


def _inflate(source: Source, at: int) -> tuple[bytes, int, str | None]:
    """What can be inflated of the member at ``at``, where it ends, and what is wrong with it."""
    if source.read(at, 3) != _MAGIC:
        raise Bad("gzip magic")
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            piece = source.read(pos, 1 << 16)
            if not piece:
                return b"".join(out), pos, "truncated"
            kept = inflate.copy()
            made = inflate.decompress(piece)
            if not out and made and not b"WARC/1."[: len(made)] == made[:7]:
                raise Bad("version line")
            out.append(made)
            pos += len(piece)
    except zlib.error:
        with contextlib.suppress(zlib.error):  # what came out before the fault
            for k in range(len(piece)):
                out.append(kept.decompress(piece[k : k + 1]))
        return b"".join(out), pos, "gzip check"
    return b"".join(out), pos - len(inflate.unused_data), None


def _at(source: Source, at: int, zipped: bool) -> tuple[list[tuple[dict[str, str], bytes]], int, str | None]:
    """The checked records of the member or plain record at ``at``, its end, and why others of the member were lost, if any."""
    if not zipped:
        fields, block, end = _parse(source.read, source.size, at)
        return [(fields, _checked(fields, source.read(block, end - 4 - block)))], end, None
    data, end, wrong = _inflate(source, at)
    found, pos = [], 0
    while pos < len(data):
        try:
            fields, block, stop = _parse(lambda a, n: data[a : a + n], len(data), pos)
            payload = _checked(fields, data[block : stop - 4])
            if wrong and "warc-block-digest" not in fields:
                raise Bad(wrong)  # nothing but the member's own check could vouch for it
        except Bad as e:
            wrong = wrong or str(e)
            pos = data.find(b"WARC/1.", pos + 1)
            if pos < 0:
                break
        else:
            found.append((fields, payload))
            pos = stop
    if not found:
        raise Bad(wrong or "empty member")
    return found, end, wrong


def salvage(file, size: int) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """(offset, bytes, None, fields, payload) for each record, (offset, bytes, reason, None, None) for each gap."""
    source, at = Source(file, size), 0
    zipped = source.read(0, 2) == _MAGIC[:2] if size else False
    if size and not zipped and not source.read(0, 5) == b"WARC/":  # a damaged start: what comes first later?
        gz, plain = source.find(_MAGIC, 0), source.find(b"WARC/1.", 0)
        zipped = gz >= 0 and (plain < 0 or gz < plain)
    mark = _MAGIC if zipped else b"WARC/1."
    while at < size:
        try:
            found, end, wrong = _at(source, at, zipped)
        except Bad as e:
            reason, next_ = str(e), at
            while (next_ := source.find(mark, next_ + 1)) >= 0:
                try:
                    found, end, wrong = _at(source, next_, zipped)
                    break
                except Bad:
                    continue
            yield at, (next_ if next_ >= 0 else size) - at, reason, None, None
            if next_ < 0:
                return
            at = next_
        for fields, payload in found:
            yield at, end - at, None, fields, payload
        if wrong in ("truncated", "gzip check"):  # where a damaged member ends is not known: at the next one at which a record passes
            next_ = at
            while (next_ := source.find(mark, next_ + 1)) >= 0:
                try:
                    _at(source, next_, zipped)
                    break
                except Bad:
                    continue
            end = next_ if next_ >= 0 else size
        if wrong:
            yield at, end - at, wrong, None, None
        at = end


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _whole(x: str) -> int | None:
    """A number of bytes, as far as the field holds one."""
    return int(x) if re.fullmatch(r"[0-9]{1,18}", x) else None


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives that ``manifest`` (archive) names. Gaps have a ``reason``."""
    n = max(1, manifest.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _folder(folder)
        columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        whole = ["offset", "bytes", "page_id", "payload_bytes", "refers_to"]
        for frame in frames:
            for path in frame["archive"]:
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, size, reason, fields, payload in salvage(file, file.size()):
                        if reason is not None:
                            rows.append((path, offset, size, reason, None, None, None, None, None, None, None))
                        else:
                            revisit = fields["warc-type"] == "revisit"
                            length = _whole(fields.get("x-payload-length", "")) if revisit else len(payload)
                            digest = fields.get("warc-payload-digest", "sha1:")[5:] if revisit else sha1_32(payload)
                            keep = payload if with_payload and not revisit else None
                            rows.append((path, offset, size, None, fields["warc-type"], _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, digest, _page(fields.get("warc-refers-to")), keep))
                            held += len(keep or b"")
                        if len(rows) >= 4096 or held >= 16 * _PIECE:
                            yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(whole, "Int64"))
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(whole, "Int64"))

    return manifest.select("archive").repartition(n).mapInPandas(run, READ_SCHEMA)


def round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back: the digest columns."""
    spark = pages.sparkSession
    folder = Scratch(spark, "archives").root
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = write_archives(pages, folder, roll_bytes)
    back = read_archives(spark, manifest, folder, with_payload=False)
    return back.where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB gives SHA-1 in hex; five digits are four letters of base 32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + CAST((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER)]), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (d)
"""
