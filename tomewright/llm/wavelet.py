"""Token ids in one wavelet matrix a shard.

A shard file holds the token ids of its documents as one bit-plane a bit of the
vocabulary, most significant first; at each plane the ids with a 0 bit move in front
of those with a 1, in order. Planes are cut into blocks that are compressed one by
one; a directory gives each block's place and the number of 1 bits before it, so
rank and select read single blocks, in which they count by bytes. From the file alone
follow: the ids at positions (`access`), the number of times ids occur in ranges
(`counts`), and where an id occurs (`occurrences`); each takes many positions at once.

A shard is cut at document ends after `shard_tokens` tokens; nothing is shuffled. A
file appears under its name only when it is complete, so a repeated task does no harm.

Defined results: a null or empty text is a document of the separator alone; a
document longer than shard_tokens has a shard of its own; a null doc_id is kept as
null; repeated rows are stored each, and their order (there are no ties) is that of the
partition; an empty table has no shards; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import filesystem, materialize, shared_folder
from .text import lean
from .tokenizer import TokenizerParams, encode, ship

MAGIC = b"WVLT0001"
NO_ID = -(2**63)


@dataclass(frozen=True)
class WaveletParams:
    shard_tokens: int = 8_000_000
    block_bits: int = 1 << 16
    level: int = 1
    tokenizer: TokenizerParams = TokenizerParams()


#: Ids that are moved at once, so that they stay in a core's cache.
CACHED = 1 << 17


def planes(ids: np.ndarray, bits: int):
    """(packed bits, number of 0 bits) of each plane."""
    a, b = ids, np.empty_like(ids)
    for k in range(bits - 1, -1, -1):
        bit = (a & a.dtype.type(1 << k)).astype(bool)
        n_zeros = len(a) - int(np.count_nonzero(bit))
        yield np.packbits(bit, bitorder="little"), n_zeros
        zero, one = 0, n_zeros
        for i in range(0, len(a), CACHED):
            own, ones = a[i : i + CACHED], bit[i : i + CACHED]
            n = int(np.count_nonzero(ones))
            b[one : one + n] = own[ones]
            b[zero : zero + len(own) - n] = own[~ones]
            zero, one = zero + len(own) - n, one + n
        a, b = b, (np.empty_like(a) if a is ids else a)


def fingerprints(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number a document, from its ids and their places, so that a changed order changes it."""
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(ids))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
        w = np.arange(starts[at], ends[to - 1], dtype=np.uint64)
        w *= np.uint64(0x9E3779B97F4A7C15)
        w += np.uint64(0xBF58476D1CE4E5B9)
        w *= ids[starts[at] : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(w, starts[at:to] - starts[at])
        at = to
    return out.view(np.int64)


def _select_table() -> np.ndarray:
    """[byte, j]: the place of the j-th 1 bit of a byte."""
    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        at = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(at)] = at
    return out


SELECT = _select_table()


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, p: WaveletParams) -> bytes:
    """The bytes of a shard file. starts: first token of each document."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=p.level).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    step, parts, at, directory = p.block_bits // 8, [], 0, []
    for packed, zeros in planes(a, bits):
        blocks = [compress(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else np.empty(0, np.int64)
        directory.append({"zeros": zeros, "at": np.cumsum([at, *map(len, blocks)]).tolist(), "ones": np.concatenate([[0], np.cumsum(ones)]).tolist()})
        at += sum(map(len, blocks))
        parts += blocks
    docs = compress(np.stack([doc_ids, starts, fingerprints(a, starts)]).astype(np.int64).tobytes())
    head = compress(json.dumps({"n": len(a), "bits": bits, "block_bits": p.block_bits, "docs": len(docs), "planes": directory}).encode())
    body = MAGIC + struct.pack("<I", len(head)) + head + docs + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """Reads a shard file; `read(at, size)` gives bytes of it."""

    def __init__(self, read, size: int):
        import zstandard

        self._read, self._inflate = read, zstandard.ZstdDecompressor().decompress
        if read(0, 8) != MAGIC:
            raise ValueError("not a shard file")
        (n,) = struct.unpack("<I", read(8, 4))
        head = json.loads(self._inflate(read(12, n)))
        self.n, self.bits, self.block_bits, self.planes = head["n"], head["bits"], head["block_bits"], head["planes"]
        for x in self.planes:
            x["ones"] = np.array(x["ones"], np.int64)
        self.doc_ids, self.starts, self.fingerprints = np.frombuffer(self._inflate(read(12 + n, head["docs"])), np.int64).reshape(3, -1)
        self._base, self.size = 12 + n + head["docs"], size
        self.block = lru_cache(64)(self._block)

    @staticmethod
    def of(data: bytes) -> Shard:
        return Shard(lambda at, size: data[at : at + size], len(data))

    def intact(self) -> bool:
        return zlib.crc32(self._read(0, self.size - 4)) == struct.unpack("<I", self._read(self.size - 4, 4))[0]

    def _packed(self, level: int, block: int) -> np.ndarray:
        at = self.planes[level]["at"]
        return np.frombuffer(self._inflate(self._read(self._base + at[block], at[block + 1] - at[block])), np.uint8)

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a block and the number of 1 bits before each."""
        packed = self._packed(level, block)
        return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    def _by_block(self, blocks: np.ndarray):
        """(block, range of places) of each run of equal blocks; blocks ascends."""
        if not len(blocks):
            return
        cut = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        for x, y in zip(cut, np.append(cut[1:], len(blocks)), strict=True):
            yield int(blocks[x]), slice(x, y)

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """1 bits before each position; positions may come in any order."""
        order = np.argsort(at, kind="stable")
        i = at[order]
        b, r = i // self.block_bits, i % self.block_bits
        ones = self.planes[level]["ones"]
        found = ones[b].copy()
        inside = np.flatnonzero(r)
        for block, own in self._by_block(b[inside]):
            packed, before = self.block(level, block)
            q = r[inside[own]]
            byte = packed[np.minimum(q >> 3, len(packed) - 1)] & ((1 << (q & 7)) - 1).astype(np.uint8)
            found[inside[own]] += before[q >> 3] + np.bitwise_count(byte)
        out = np.empty_like(found)
        out[order] = found
        return out

    def select(self, level: int, bit: int, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) bits of this value; j ascends."""
        ones = self.planes[level]["ones"]
        before = ones if bit else np.minimum(np.arange(len(ones)) * self.block_bits, self.n) - ones
        b = np.searchsorted(before, j, "right") - 1
        out = np.empty(len(j), np.int64)
        for block, own in self._by_block(b):
            packed, held = self.block(level, block)
            if not bit:
                packed, held = ~packed, 8 * np.arange(len(held)) - held
            q = j[own] - before[block]
            byte = np.searchsorted(held, q, "right") - 1
            out[own] = block * self.block_bits + 8 * byte + SELECT[packed[byte], q - held[byte]]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(at)
        value = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            ones = self.rank1(level, at)
            bit = self.rank1(level, at + 1) - ones
            value = value * 2 + bit
            at = np.where(bit == 1, plane["zeros"] + ones, at - ones)
        return value

    def _descend(self, tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level, plane in enumerate(self.planes):
            ranks = self.rank1(level, np.concatenate([a, b]))
            x, y = ranks[: len(a)], ranks[len(a) :]
            one = tokens >> (self.bits - 1 - level) & 1 == 1
            a, b = np.where(one, plane["zeros"] + x, a - x), np.where(one, plane["zeros"] + y, b - y)
        return a, b

    def counts(self, tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Times that each token occurs in positions [a, b) of its own."""
        tokens = np.asarray(tokens, np.int64)
        known = (tokens >= 0) & (tokens >> self.bits == 0)
        x, y = self._descend(np.where(known, tokens, 0), np.asarray(a, np.int64), np.asarray(b, np.int64))
        return np.where(known, y - x, 0)

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Times that the token occurs in positions [a, b)."""
        return int(self.counts(np.array([token]), np.array([a]), np.array([self.n if b is None else b]))[0])

    def occurrences(self, token: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Positions in [a, b) at which the token occurs, ascending. All hits go up a plane at once."""
        if token < 0 or token >> self.bits:
            return np.empty(0, np.int64)
        low, high = (int(x[0]) for x in self._descend(np.array([token]), np.array([a]), np.array([self.n if b is None else b])))
        at = np.arange(low, high)
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self.select(level, bit, at - self.planes[level]["zeros"] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All token ids, plane by plane from the last to the first."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            packed = [self._packed(level, b) for b in range(len(self.planes[level]["at"]) - 1)]
            bit = np.unpackbits(np.concatenate(packed), bitorder="little")[: self.n].view(bool) if packed else np.zeros(0, bool)
            up, zero, one, set_ = np.empty_like(v), 0, self.planes[level]["zeros"], v.dtype.type(1 << (self.bits - 1 - level))
            for i in range(0, self.n, CACHED):
                own, ones = up[i : i + CACHED], bit[i : i + CACHED]
                n = int(np.count_nonzero(ones))
                own[ones] = v[one : one + n] | set_
                own[~ones] = v[zero : zero + len(own) - n]
                zero, one = zero + len(own) - n, one + n
            v = up
        return v


def write_shards(docs: DataFrame, folder: str, p: WaveletParams = WaveletParams()) -> DataFrame:
    """Writes the shard files below `folder`; gives a table of file, documents, tokens and bytes."""

    ship(docs.sparkSession, p.tokenizer)

    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        number, ids, parts, size = 0, [], [], 0
        end = np.array([p.tokenizer.separator], np.uint32)

        def flush() -> pd.DataFrame:
            starts = np.cumsum([0, *(len(x) for x in parts[:-1])])
            data = encode_shard(np.concatenate(parts), np.array(ids, np.int64), starts, p)
            name = f"shard-{TaskContext.get().partitionId():06d}-{number:04d}.wvl"
            temporary = f"{path}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            fs.move(temporary, f"{path}/{name}")
            return pd.DataFrame({"file": [f"{folder}/{name}"], "documents": [len(ids)], "tokens": [size], "bytes": [len(data)]})

        for pdf in batches:
            for d, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                own = np.concatenate([encode(text, p.tokenizer), end])
                if size and size + len(own) > p.shard_tokens:
                    yield flush()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(NO_ID if d is pd.NA else int(d))
                parts.append(own)
                size += len(own)
        if ids:
            yield flush()

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialize(picked.mapInPandas(lean(run), "file string, documents long, tokens long, bytes long"), "shards")


def open_shard(name: str) -> Shard:
    """Shard whose blocks are read from the file when they are needed."""
    fs, path = filesystem(name)
    f = fs.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return Shard(read, f.size())


def read_documents(files: DataFrame, separator: int) -> DataFrame:
    """doc_id, shard, start, n_tokens, token_sum, first_token, n_first, fingerprint and intact of every document, from the files alone.

    Documents end where the separator occurs (by select); first_token is read by access and counted in its document
    by rank; sums and fingerprints come from the whole of the decoded ids. intact: the file's checksum, the ends, the
    order of the ids and the first token all agree."""

    def run(batches):
        for pdf in batches:
            for name in pdf["file"]:
                s = open_shard(name)
                ends = s.occurrences(separator) + 1
                starts = np.concatenate([[0], ends[:-1]])
                same = s.intact() and s.count(separator) == len(s.starts) and np.array_equal(starts, s.starts) and ends[-1] == s.n
                if not same:
                    starts, ends = s.starts, np.append(s.starts[1:], s.n)
                first = s.access(starts)
                n_first = s.counts(first, starts, ends)
                ids = s.decode()
                prints = fingerprints(ids, starts)
                ok = same & (prints == s.fingerprints) & (ids[starts] == first)
                yield pd.DataFrame({"doc_id": pd.array(s.doc_ids, "Int64"), "shard": name.rsplit("/", 1)[1], "start": starts, "n_tokens": ends - starts, "token_sum": np.add.reduceat(ids, starts, dtype=np.int64), "first_token": first, "n_first": n_first, "fingerprint": prints, "intact": ok}).assign(doc_id=lambda x: x["doc_id"].mask(x["doc_id"] == NO_ID))

    return files.select("file").mapInPandas(lean(run), "doc_id long, shard string, start long, n_tokens long, token_sum long, first_token long, n_first long, fingerprint long, intact boolean")


def tokenise(docs: DataFrame, p: WaveletParams = WaveletParams()) -> DataFrame:
    """Writes all documents as shards in the shared folder and reads them back."""
    files = write_shards(docs, shared_folder(docs.sparkSession, "tokens"), p)
    return read_documents(files.repartitionByRange(max(1, files.count()), "file"), p.tokenizer.separator)
