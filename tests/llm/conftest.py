import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "amber birch cedar dune ember fjord grove heron iris jade kelp lark maple north ocean pine quartz river stone tide umber vale willow yarrow zephyr".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed", "ly"]) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        """Rows of (doc_id, text[, lang]). extra: columns whose names operators use themselves."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("class", "tile", "score", "votes", "toxic", "kept", "at", "edge", "window_id", "is_open", "_id", "term", "segment", "file", "flagged", "gone_id", "gone_version", "leaked", "clean", "_gone", "_leaked", "_clean", "row", "version", "_part", "es", "low", "high"):
                frame = frame.selectExpr("*", f"'x' AS `{c}`")
        return frame

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    long = prose(1, 60_000)
    rows = [(1, None, None), (None, prose(2, 80)), (3, ""), (4, " \n\t "), (5, long), (6, prose(3, 120)), (6, prose(3, 120)), (7, "é" * 50_000), (8, "x"), (None, None, None), (9, prose(3, 120), None)]
    return make_docs(rows, extra=True)


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return make_docs([])
