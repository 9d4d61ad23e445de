"""Public byte-level BPE vocabularies, read from a path that the caller names."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class TokenizerParams:
    """path: a file of `base64 rank` lines, which the driver ships to the executors; separator: the id put after each document.
    The pattern is the vocabulary's own, with possessive quantifiers, which split alike and faster."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    separator: int = 50256


def ship(spark: SparkSession, p: TokenizerParams) -> None:
    """Sends the vocabulary file to all executors, which need not have it."""
    spark.sparkContext.addFile(p.path)


def load(p: TokenizerParams):
    """The vocabulary, kept by the library for the life of a Python worker."""
    import tiktoken
    from tiktoken import registry

    name = f"{p.path}\n{p.pattern}"
    if name not in registry.ENCODINGS:
        with open(p.path if os.path.exists(p.path) else SparkFiles.get(os.path.basename(p.path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        registry.ENCODINGS[name] = tiktoken.Encoding(p.path, pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def encode_list(text: str | None, p: TokenizerParams) -> list[int]:
    """Token ids of one text (empty for null or empty text), without the separator. Text that looks like a special token is text."""
    return load(p).encode_ordinary(text) if text else []


def encode(text: str | None, p: TokenizerParams) -> np.ndarray:
    return np.array(encode_list(text, p), np.uint32)
