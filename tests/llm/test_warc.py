import base64
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomewright.llm import warc as W


def record(content=b"hello", length=None, digest=None, kind="response", end=b"\r\n\r\n", extra=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *extra]
    if digest is not None:
        lines.append(f"WARC-Block-Digest: {digest}")
    if length != "none":
        lines.append(f"Content-Length: {len(content) if length is None else length}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + end


class Slow(io.BytesIO):
    """Gives a few bytes at a time."""

    def __init__(self, data, step):
        super().__init__(data)
        self.step = step

    def read(self, n=-1):
        return super().read(min(n, self.step))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 70))
def test_members(contents, step):
    data = b"".join(gzip.compress(record(c, digest=W.digest(c))) for c in contents)
    got = list(W.read_records(Slow(data, step)))
    assert [(r.content, r.digest_ok, r.error) for r in got] == [(c, True, None) for c in contents]
    for r in got:
        assert data[r.at : r.at + 3] == W.MAGIC


@pytest.mark.parametrize(
    ("raw", "error"),
    [(record(digest="sha1:WRONG"), None), (record(length="none"), "no Content-Length"), (record(length="99"), "content is shorter than Content-Length"), (record(length="x"), "no Content-Length"), (record(length="²"), "no Content-Length"), (record(length="9" * 30), "no Content-Length"), (record(length="-1"), "no Content-Length"), (b"junk", "no WARC header"), (record(end=b""), "record doesn't end with two line ends"), (record(length="3"), "record doesn't end with two line ends")],
)
def test_broken_records(raw, error):
    good = gzip.compress(record(b"next", digest=W.digest(b"next")))
    bad, after = W.read_records(io.BytesIO(gzip.compress(raw) + good))
    assert bad.error == error and bad.digest_ok in (None, False)
    assert after.content == b"next" and after.digest_ok


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_broken_gzip(step):
    good = gzip.compress(record(b"next"))
    cut = gzip.compress(record(b"a" * 50))[:-20]
    rows = list(W.read_records(Slow(good + cut, step)))
    assert [r.error for r in rows] == [None, "truncated gzip member"]
    damaged = bytearray(gzip.compress(record(bytes(range(256)) * 20)))
    damaged[40] ^= 0xFF
    rows = list(W.read_records(Slow(bytes(damaged) + good, step)))
    assert rows[0].error and rows[-1].content == b"next" and rows[-1].error is None
    rows = list(W.read_records(Slow(b"not gzip at all" + good, step)))
    assert rows[0].error and rows[-1].content == b"next"
    assert list(W.read_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("name", ["sha1", "sha256", "sha512", "md5", "SHA-256"])
def test_digests_of_every_coding(name):
    raw = hashlib.new(name.lower().replace("-", ""), b"x").digest()
    b32, b64 = base64.b32encode(raw).decode(), base64.b64encode(raw).decode()
    for said in (raw.hex(), raw.hex().upper(), b32, b32.lower(), b32.rstrip("="), b64, b64.rstrip("="), base64.urlsafe_b64encode(raw).decode()):
        assert W.digest_ok(f"{name}:{said}", b"x") is True and W.digest_ok(f"{name}:{said}", b"y") is False
    assert W.digest_ok(f"{name}:?", b"x") is False
    assert W.digest_ok("crc32:00", b"x") is None and W.digest_ok("", b"x") is None and W.digest_ok("no mark", b"x") is None


def test_a_member_beyond_the_bound_is_an_error(monkeypatch):
    monkeypatch.setattr(W, "MOST_BYTES", 1000)
    good = gzip.compress(record(b"next"))
    rows = list(W.read_records(io.BytesIO(gzip.compress(record(b"a" * 5000)) + good)))
    assert "more than 1000 bytes" in rows[0].error and rows[-1].content == b"next"


def test_odd_page_numbers(spark, tmp_path):
    said = ["--5", "²", str(2**63), str(-(2**63)), "7", "", "1" * 40]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(record(b"x", extra=(f"X-Page-Id: {x}",))) for x in said))
    rows = W.read_warc(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "file string")).orderBy("record").collect()
    assert [r["page_id"] for r in rows] == [None, None, None, -(2**63), 7, None, None]


def test_no_digest_and_other_kinds():
    (r,) = W.read_records(io.BytesIO(gzip.compress(record(b"x", kind="warcinfo"))))
    assert r.digest_ok is None and r.headers["warc-type"] == "warcinfo"


def test_pages(spark, tmp_path):
    pages = [(1, "http://a.org/", "<p>one</p>"), (2, None, None), (None, "http://b.org/\r\nX: y", ""), (4, "http://c.org/é", "ü\r\n\r\n" * 200_000), (1, "http://a.org/", "<p>one</p>"), (5, "", "x")]
    frame = spark.createDataFrame([(*p, "k", "f", True) for p in pages], "page_id long, url string, html string, kind string, file string, digest_ok boolean")
    rows = W.round_trip(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    expected = [(a, None if b is None else b.replace("\r", "%0D").replace("\n", "%0A"), c or "", len((c or "").encode()), True) for a, b, c in pages]
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert W.round_trip(frame.limit(0)).count() == 0


def test_files_from_elsewhere(spark, tmp_path):
    for i in range(3):
        body = b"HTTP/1.1 200 OK\r\n\r\nbody%d" % i
        (tmp_path / f"{i}.warc.gz").write_bytes(gzip.compress(record(b"software: x", kind="warcinfo")) + gzip.compress(record(body, digest=W.digest(body), extra=("Content-Type: application/http", "WARC-Target-URI: http://x/"))))
    files = spark.createDataFrame([(f"file://{tmp_path}/{i}.warc.gz",) for i in range(3)], "file string")
    rows = W.read_warc(files).where("kind = 'response'").collect()
    assert sorted(bytes(r["payload"]) for r in rows) == [b"body0", b"body1", b"body2"] and all(r["digest_ok"] for r in rows)
    assert zlib.crc32(b"") == 0
