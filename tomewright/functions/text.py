"""Tokenizers as column expressions; both stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a an and as at by for in is of on the to which with".split())


def ascii_tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, repeats kept. Null text gives null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def unicode_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script, without stop words and one-byte words."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def first_ascii_token(word: str) -> str:
    """First run of ASCII letters and digits of a query word, lower-cased; empty if there is none."""
    run = ""
    for c in word.lower():
        if c.isascii() and c.isalnum():
            run += c
        elif run:
            break
    return run


def analyze(query: str) -> list[str]:
    """unicode_tokens of a query string, computed on the driver."""
    words, run = [], ""
    for c in query + " ":
        if c.isalpha() or c.isnumeric():
            run += c
        elif run:
            words.append(run.lower())
            run = ""
    return [w for w in words if len(w.encode()) > 1 and w not in STOP_WORDS]
