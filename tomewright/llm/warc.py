"""WARC: a sequential reader of gzipped archives, one gzip member per record, and a writer.

The reader decompresses in small steps (zlib, no whole file in memory), finds the
end of a record's content by its Content-Length and checks WARC-Block-Digest (SHA-1,
SHA-256, SHA-512 or MD5, in base32, hexadecimal or base64, in any case where the
coding has none). One task reads a file from start to end; files are the unit of
parallelism. A member is inflated up to `MOST_BYTES`, which bounds what a broken or
hostile one can take.

Defined results: a record whose digest differs has digest_ok false, one without a
digest, or of an algorithm that isn't known here, null; a broken record has `error`
set (a member beyond MOST_BYTES, a Content-Length that is no ASCII number or longer
than the content, missing ends), and the reader goes on at the next gzip member where
one can be found; an X-Page-Id that is no 64-bit number is null; repeated headers: the
last counts; an empty file has no records; an empty table writes files without
records. The writer writes one response record a row, repeated rows one each; a very
long page is one record; null html has an empty body, null url no WARC-Target-URI, and
a null page_id no X-Page-Id; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filesystem, materialize, shared_folder
from .text import lean

SCHEMA = "file string, record long, at long, kind string, uri string, page_id long, length long, digest_ok boolean, payload binary, error string"
STEP = 1 << 16
MAGIC = b"\x1f\x8b\x08"
#: The most that one value of a row can hold.
MOST_BYTES = (1 << 31) - (1 << 16)


@dataclass
class Record:
    at: int
    headers: dict[str, str]
    content: bytes
    digest_ok: bool | None
    error: str | None = None


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def digest_ok(said: str | None, content: bytes) -> bool | None:
    """Whether a digest of the form `algorithm:value` is the content's; null if there is none or none that can be checked."""
    name, mark, value = (said or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if not mark or name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own, value = hashlib.new(name, content).digest(), value.strip()
    if re.fullmatch(f"[0-9A-Fa-f]{{{2 * len(own)}}}", value):
        return value.lower() == own.hex()
    if value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("="):
        return True
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if re.search("[-_]", value) else None) == own
    except (binascii.Error, ValueError):
        return False


def members(stream) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, content, error) of each gzip member; after a broken one, goes on at the next magic number."""
    held, base, eof = b"", 0, False
    while True:
        while len(held) < 3 and not eof:
            more = stream.read(STEP)
            eof = not more
            held += more
        if not held:
            return
        start, parts, error, used = base, [], None, 0
        inflate = zlib.decompressobj(31)
        pending, held_bytes = held, 0
        try:
            while not inflate.eof:
                if not pending:
                    pending = stream.read(STEP)
                    if not pending:
                        eof, error = True, "truncated gzip member"
                        break
                parts.append(inflate.decompress(pending, MOST_BYTES - held_bytes + 1))
                held_bytes += len(parts[-1])
                if held_bytes > MOST_BYTES:
                    raise zlib.error(f"member of more than {MOST_BYTES} bytes")
                used += len(pending)
                pending = b""
        except zlib.error as e:
            error, used = f"gzip: {e}", used + len(pending)
        if error is None:
            held = inflate.unused_data
            base = start + used - len(held)
        elif eof:
            held, base = b"", start + used
        else:
            # what was read of the broken member before this step is gone; look on in this step and after it
            rest, skipped = (pending or b"")[1 if used == len(pending) else 0 :], used - len(pending or b"") + (1 if used == len(pending) else 0)
            while True:
                k = rest.find(MAGIC)
                if k >= 0:
                    held, base = rest[k:], start + skipped + k
                    break
                keep = rest[-2:]
                more = stream.read(STEP)
                if not more:
                    held, base, eof = b"", start + skipped + len(rest), True
                    break
                skipped += len(rest) - len(keep)
                rest = keep + more
        yield start, b"".join(parts), error
        if not held and eof:
            return


def parse(at: int, raw: bytes, error: str | None) -> Record:
    """Frames one record by its Content-Length."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if error:
        return Record(at, headers, b"", None, error)
    if not mark or not lines[0].startswith("WARC/"):
        return Record(at, headers, b"", None, "no WARC header")
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size, re.ASCII):
        return Record(at, headers, b"", None, "no Content-Length")
    if len(body) < int(size):
        return Record(at, headers, b"", None, "content is shorter than Content-Length")
    content, rest = body[: int(size)], body[int(size) :]
    if rest != b"\r\n\r\n":
        return Record(at, headers, content, None, "record doesn't end with two line ends")
    return Record(at, headers, content, digest_ok(headers.get("warc-block-digest"), content))


def page_number(text: str) -> int | None:
    """A 64-bit number in ASCII digits; null for anything else."""
    if not re.fullmatch("-?[0-9]{1,19}", text, re.ASCII):
        return None
    return n if -(2**63) <= (n := int(text)) < 2**63 else None


def read_records(stream) -> Iterator[Record]:
    for at, raw, error in members(stream):
        yield parse(at, raw, error)


def http_body(content: bytes) -> bytes:
    return content.partition(b"\r\n\r\n")[2]


def response_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One gzip member that holds an HTTP response."""
    body = (html or "").encode("utf-8", "replace")
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {clean}"] * (clean is not None) + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {digest(content)}", f"Content-Length: {len(content)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + content + b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a partition below `folder`; gives a table of file, records and bytes.
    A file appears under its name only when it is complete, so a repeated task does no harm."""

    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, n, size = f"{path}/.{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for pdf in batches:
                for page_id, url, html in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["html"], strict=True):
                    raw = response_record(None if page_id is pd.NA else int(page_id), url, html)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        fs.move(temporary, f"{path}/{name}")
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    picked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return picked.mapInPandas(lean(run), "file string, records long, bytes long")


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the archives named in the column `file`."""

    def rows(name: str) -> Iterator[tuple]:
        fs, path = filesystem(name)
        with fs.open_input_stream(path, compression=None, buffer_size=0) as stream:
            for n, r in enumerate(read_records(stream)):
                http = r.headers.get("content-type", "").startswith("application/http")
                yield name, n, r.at, r.headers.get("warc-type"), r.headers.get("warc-target-uri"), page_number(r.headers.get("x-page-id", "")), len(r.content), r.digest_ok, http_body(r.content) if http else r.content, r.error

    def frame(held: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=["file", "record", "at", "kind", "uri", "page_id", "length", "digest_ok", "payload", "error"], dtype=object)
        return out.astype({"record": "int64", "at": "int64", "length": "int64", "page_id": "Int64", "digest_ok": "boolean"})

    def run(batches):
        for pdf in batches:
            for name in pdf["file"]:
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += len(row[8])
                    if size > 4_000_000 or len(held) >= 2000:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    return files.select("file").mapInPandas(lean(run), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads all of them back: page_id, url, html, n_bytes, digest_ok."""
    spark = pages.sparkSession
    written = materialize(write_warc(pages, shared_folder(spark, "warc")), "warc-files")
    n = written.count()
    read = read_warc(written.select("file").repartitionByRange(max(1, n), "file"))
    return read.select("page_id", F.col("uri").alias("url"), F.decode("payload", "utf-8").alias("html"), F.octet_length("payload").cast("bigint").alias("n_bytes"), "digest_ok")
