"""Codec envelopes, size models of run-length and prefix codes, checksums.

A payload in an envelope starts with the codec's one-byte id. Codecs work on Arrow
batches; everything else is plain Spark expressions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BLOCK = 32700
RUN_MARK = 0xFE
HEADER_BYTES = 6
MAGIC = b"SH"


class Codec(Protocol):
    """Extension point: anything with an id from 0 to 255 that encodes bytes and gets them back."""

    id: int

    def encode(self, raw: bytes) -> bytes: ...

    def decode(self, packed: bytes) -> bytes: ...


@dataclass(frozen=True)
class ZlibCodec:
    id: int = 0x53
    level: int = 6

    def encode(self, raw: bytes) -> bytes:
        return zlib.compress(raw, self.level)

    def decode(self, packed: bytes) -> bytes:
        return zlib.decompress(packed)


@dataclass(frozen=True)
class RunPrefixCodec:
    """Block codec: a 6-byte header (mark, length of the block, number of symbols modulo 65536), runs of 4 to 255 equal bytes
    as three symbols, then a canonical prefix code of 7, 8 or 9 bits. A literal run mark is written as a run, so every
    block of 1 to 32700 bytes comes back as it was; the reader goes by the length."""

    id: int = 0x48

    def encode(self, raw: bytes) -> bytes:
        if not 1 <= len(raw) <= MAX_BLOCK:
            raise ValueError("invalid compression parameters")
        symbols = np.frombuffer(run_symbols(raw), np.uint8)
        bits = _CODE_BITS[symbols][_CODE_MASK[symbols]]
        return MAGIC + len(raw).to_bytes(2, "big") + (len(symbols) & 0xFFFF).to_bytes(2, "big") + np.packbits(bits).tobytes()

    def decode(self, packed: bytes) -> bytes:
        if packed[:2] != MAGIC or len(packed) < HEADER_BYTES:
            raise ValueError("no block header")
        size = int.from_bytes(packed[2:4], "big")
        symbols = _symbols_of(np.frombuffer(packed, np.uint8, offset=HEADER_BYTES))
        times = np.ones(len(symbols), np.int64)
        after = 0
        for at in np.flatnonzero(symbols == RUN_MARK).tolist():
            if at >= after:  # else it is the times or the byte of the run before
                after = at + 3
                times[at : at + 2] = 0
                times[at + 2 : after] = symbols[at + 1 : at + 2]
        total = np.cumsum(times)
        end = int(np.searchsorted(total, size))
        if size and end == len(symbols):
            raise ValueError("block ends before its length")
        if size and total[end] != size:
            raise ValueError("block has another length than its header says")
        return np.repeat(symbols[: end + 1], times[: end + 1]).tobytes() if size else b""


def _symbols_of(raw: np.ndarray) -> np.ndarray:
    """Every symbol that starts within the bytes of a prefix code. Where a symbol starts depends on all before it: places are
    linked to the next one, then to the eighth, so that only each eighth is gone to one at a time."""
    if not len(raw):
        return np.zeros(0, np.uint8)
    n = 8 * len(raw)
    wide = np.zeros(len(raw) + 2, np.uint32)
    wide[:-2] = raw
    wide = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    window = ((wide[:, None] >> _SHIFTS) & 511).ravel()  # the 9 bits from each place on
    links = np.full(n + 1, n, np.int32)
    np.minimum(np.arange(n, dtype=np.int32) + _STEP[window], n, out=links[:n])
    far = links
    for _ in range(3):
        far = far[far]
    view, at, places = memoryview(far), 0, []
    while at < n:
        places.append(at)
        at = view[at]
    place = np.array(places, np.int32)
    rows = [place]
    for _ in range(7):
        rows.append(links[rows[-1]])
    place = np.stack(rows, 1).ravel()
    return _SYMBOL[window[place[: np.searchsorted(place, n)]]]


def run_symbols(raw: bytes) -> bytes:
    """The symbols of a block: run mark, times and byte for each run of 4 or more and for a run mark, else the bytes."""
    a = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if len(a) else np.zeros(0, np.int64)
    times = np.diff(starts, append=len(a))
    marked = (times >= 4) | (a[starts] == RUN_MARK)
    symbols, at = bytearray(), 0
    for start, n in zip(starts[marked].tolist(), times[marked].tolist(), strict=True):
        symbols += raw[at:start]
        value, at = raw[start], start + n
        while n:
            part = min(n, 255)
            symbols += bytes((RUN_MARK, part, value)) if part >= 4 or value == RUN_MARK else bytes([value]) * part
            n -= part
    return bytes(symbols + raw[at:])


def blocks(raw: bytes) -> list[bytes]:
    """Bytes of any length as blocks that the block codec takes."""
    return [raw[i : i + MAX_BLOCK] for i in range(0, len(raw), MAX_BLOCK)]


@dataclass(frozen=True)
class BlockCodec:
    """Values of any length as blocks of the block codec, each behind its length in 4 bytes."""

    id: int = 0x49

    def encode(self, raw: bytes) -> bytes:
        packed = [RunPrefixCodec().encode(x) for x in blocks(raw)]
        return b"".join(len(x).to_bytes(4, "big") + x for x in packed)

    def decode(self, packed: bytes) -> bytes:
        out, at = [], 0
        while at < len(packed):
            n = int.from_bytes(packed[at : at + 4], "big")
            out.append(RunPrefixCodec().decode(packed[at + 4 : at + 4 + n]))
            at += 4 + n
        return b"".join(out)


def runs(raw: bytes):
    """(byte, times) of each run."""
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and raw[j] == raw[i]:
            j += 1
        yield raw[i], j - i
        i = j


def code_length(byte: int) -> int:
    c = chr(byte)
    if c in " 0123456789abcdefghijklmnopqrstuvwxyz":
        return 7
    return 8 if c in 'ABCDEFGHIJKLMNOPQRSTUVWXYZ"_:' else 9


def canonical_codes() -> dict[int, tuple[int, int]]:
    """(code, bits) of each byte: shorter codes first, then by byte."""
    out, code, before = {}, 0, 0
    for n, byte in sorted((code_length(b), b) for b in range(256)):
        code = (code << (n - before)) if before else 0
        out[byte], before = (code, n), n
        code += 1
    return out


CODES = canonical_codes()
#: Of each byte: the bits of its code, most significant first, and which of the 9 places they fill.
_CODE_MASK = np.array([[k < CODES[b][1] for k in range(9)] for b in range(256)])
_CODE_BITS = np.array([[CODES[b][0] >> (CODES[b][1] - 1 - k) & 1 if k < CODES[b][1] else 0 for k in range(9)] for b in range(256)], np.uint8)
_SHIFTS = np.arange(15, 7, -1, dtype=np.uint32)
#: By the next 9 bits: the symbol and the bits that it takes.
_SYMBOL, _STEP = np.zeros(512, np.uint8), np.ones(512, np.uint8)
for _byte, (_code, _n) in CODES.items():
    _SYMBOL[_code << (9 - _n) : (_code + 1) << (9 - _n)] = _byte
    _STEP[_code << (9 - _n) : (_code + 1) << (9 - _n)] = _n


def enveloped(value: Column, codec: Codec) -> Column:
    """Codec id and encoded payload. Null stays null."""

    @F.pandas_udf("binary")
    def pack(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes([codec.id]) + codec.encode(bytes(x)))

    return pack(value.cast("binary"))


def opened(payload: Column, codec: Codec, strict: bool = True) -> Column:
    """Value of an envelope. Of another codec's payload: an error if strict, the payload itself if not."""

    @F.pandas_udf("binary")
    def unpack(raw: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = bytes(x)
            if strict and len(x) < 2:
                raise ValueError("corrupted layout payload envelope tracking flags")
            if len(x) < 2 or x[0] != codec.id:
                if strict:
                    raise ValueError(f"mismatched compression codec boundary ID: expected 0x{codec.id:X}, got 0x{x[0]:X}")
                return x
            return codec.decode(x[1:])

        return raw.map(one)

    return unpack(payload)


def run_length_size(text: Column) -> Column:
    """Bytes of a text after run coding: a run of 4 to 255 equal bytes takes 3."""
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character a byte
    saved = F.aggregate(F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)((.)\2{3,254})"), F.lit(1)), lambda r: F.length(r) - 3), F.lit(0), lambda a, x: a + x)
    return (F.octet_length(text) - saved).cast("bigint")


def code_length_counts(text: Column) -> Column:
    """Bytes of a text that have a code of 7, 8 and 9 bits, as a struct of n7, n8 and n9."""
    n7, n8 = F.length(F.regexp_replace(text, "[^a-z0-9 ]", "")), F.length(F.regexp_replace(text, '[^A-Z"_:]', ""))
    return F.struct(n7.alias("n7"), n8.alias("n8"), (F.octet_length(text) - n7 - n8).alias("n9"))


def prefix_code_bits(text: Column) -> Column:
    """Bits of the prefix code of a text's bytes, without run coding."""
    n7 = F.length(F.regexp_replace(text, "[^a-z0-9 ]", ""))
    n8 = F.length(F.regexp_replace(text, '[^A-Z"_:]', ""))
    return (n7 * 7 + n8 * 8 + (F.octet_length(text) - n7 - n8) * 9).cast("bigint")


def packed_size(bits: Column) -> Column:
    """Bytes of a block of so many bits, with its header."""
    return (F.lit(HEADER_BYTES) + F.ceil(bits / 8)).cast("bigint")


def varint_length(value: Column) -> Column:
    """Bytes of a value of 0 or more in 7-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("bigint")


def varints(values: Column) -> Column:
    """Bytes of an array of values of 0 or more in 7-bit groups, least significant first; all but the last group of a value have the high bit."""
    group = lambda v, i, last: F.lpad(F.hex(F.shiftright(v, 7 * i).bitwiseAND(F.lit(127)) + F.when(last, 0).otherwise(128)), 2, "0")

    def digits(v: Column) -> Column:
        out = group(v, 8, F.lit(True))  # 63 bits are 9 groups
        for i in range(7, -1, -1):
            further = F.shiftright(v, 7 * (i + 1)) > 0
            out = F.concat(group(v, i, ~further), F.when(further, out).otherwise(""))
        return out

    return F.unhex(F.array_join(F.transform(values, digits), ""))


def read_varints(raw: Column) -> Column:
    """The values of varints."""

    @F.pandas_udf("array<bigint>")
    def read(parts: pd.Series) -> pd.Series:
        def one(x):
            a = np.frombuffer(x, np.uint8)
            ends = np.flatnonzero(a < 128)
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            place = np.arange(len(a)) - np.repeat(starts, ends - starts + 1) if len(ends) else np.empty(0, np.int64)
            return np.add.reduceat((a & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.empty(0, np.int64)

        return parts.map(lambda x: None if x is None else one(x))

    return read(raw)


def running_totals(values: Column) -> Column:
    """The sums up to and with each element of an array."""

    @F.pandas_udf("array<bigint>")
    def sums(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: None if x is None else np.cumsum(x))

    return sums(values)


def checksum(*parts: Column) -> Column:
    """CRC-32 (IEEE) of the concatenated bytes."""
    return F.crc32(F.concat(*[F.coalesce(p.cast("binary"), F.lit(b"")) for p in parts]))


def intact(stored: Column, *parts: Column) -> Column:
    return checksum(*parts) == stored
