"""Packing: bounded-space online best fit of documents into training windows.

Each partition keeps `open_windows` windows open. A document of t tokens and its
separator is cut into whole windows and a rest; the rest goes to the open window
that it fills best. If it fits none, the fullest open window is emitted and a new
one is opened. At the end of a partition the windows that are still open are
leftovers; they are merged across partitions by best fit in order of falling size,
in as many groups as there are `merge_group` leftovers. Only this last step
shuffles, and it moves the leftover windows only, `open_windows` a partition at most.

Defined results: null or empty text has no tokens and no row; a document longer
than a window spans several windows; repeated rows are packed each; a null doc_id
is packed as null; an empty table gives no rows; other columns are not touched,
whatever their names. Ties: of open windows with equal room the one opened first takes
a document or is emitted, and of leftovers of equal fill the one of the lower id moves
first. A very long text is tokenised whole.
The tokens [doc_from, doc_to) of a document lie at `at` of window `window_id`; each
row holds them, and a window is its rows' tokens in the order of `at`.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import lean
from .tokenizer import TokenizerParams, encode_list, ship

ROWS = "window_id long, doc_id long, doc_from long, doc_to long, at int, tokens array<int>, is_open boolean"


@dataclass(frozen=True)
class PackingParams:
    window: int = 2048
    open_windows: int = 64
    merge_group: int = 200_000
    frame_tokens: int = 1_000_000
    tokenizer: TokenizerParams = TokenizerParams()


class OpenWindows:
    """Best fit into a fixed number of open windows; each holds its pieces (window, doc, from, to, at)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (room left, window), in order
        self.pieces: dict[int, list[tuple]] = {}

    def add(self, doc: int | None, n: int) -> Iterator[tuple]:
        """Places a document of n tokens; gives the pieces of the windows that this completes."""
        whole = n // self.size * self.size
        for a in range(0, whole, self.size):
            yield self._new(), doc, a, a + self.size, 0
        if n == whole:
            return
        k = bisect_left(self.room, (n - whole, -1))
        if k < len(self.room):
            room, window = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                yield from self.pieces.pop(self.room.pop(0)[1])  # the fullest
            room, window = self.size, self._new()
        self.pieces.setdefault(window, []).append((window, doc, whole, n, self.size - room))
        if room > n - whole:
            insort(self.room, (room - (n - whole), window))
        else:
            yield from self.pieces.pop(window)

    def left(self) -> list[tuple]:
        return [piece for w in sorted(self.pieces) for piece in self.pieces[w]]

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1


def token_ids(texts: list[str | None], p: TokenizerParams) -> Iterator[np.ndarray]:
    """Tokens and separator of each text; nothing for null or empty text."""
    for t in texts:
        yield np.array([*encode_list(t, p), p.separator] if t else [], np.int32)


def merge_leftovers(fills: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(window, target, shift): best fit by falling fill; a target is the id of the first window in it."""
    room: list[tuple[int, int]] = []
    out = []
    for window, fill in sorted(fills, key=lambda x: (-x[1], x[0])):
        k = bisect_left(room, (fill, -1))
        left, target = room.pop(k) if k < len(room) else (size, window)
        out.append((window, target, size - left))
        if left > fill:
            insort(room, (left - fill, target))
    return out


def pack_documents(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """window_id, doc_id, doc_from, doc_to, at, tokens: where the tokens of every document go, and the tokens."""
    ship(docs.sparkSession, p.tokenizer)

    def frame(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
        window, doc, a, b, at, tokens = zip(*rows, strict=True)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
        columns = [pa.array(x, pa.int64()) for x in (window, doc, a, b)] + [pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([is_open] * len(rows))], names=["window_id", "doc_id", "doc_from", "doc_to", "at", "tokens", "is_open"])

    def run(batches):
        windows = OpenWindows(p.window, p.open_windows, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                docs_, texts = (batch.column(c).slice(start, 64).to_pylist() for c in (0, 1))
                for doc, ids in zip(docs_, token_ids(texts, p.tokenizer), strict=True):
                    whole = len(ids) // p.window * p.window
                    # an open window keeps the document's rest only
                    own = (doc, ids[whole:].copy())
                    for window, (d, rest), a, b, at in windows.add(own, len(ids)) if len(ids) else ():
                        rows.append((window, d, a, b, at, ids[a:b] if rest is own[1] and a < whole else rest))
                        size += b - a
                    if size > p.frame_tokens:
                        yield frame(rows, False)
                        rows, size = [], 0
        if rows:
            yield frame(rows, False)
        if left := [(window, d, a, b, at, rest) for window, (d, rest), a, b, at in windows.left()]:
            yield frame(left, True)

    def merge(batches):
        fills = [x for pdf in batches for x in zip(pdf["window_id"].tolist(), pdf["fill"].tolist(), strict=True)]
        yield pd.DataFrame(merge_leftovers(fills, p.window), columns=["window_id", "target", "shift"])

    pieces = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), ROWS), "packing")
    left = pieces.where("is_open")
    fills = left.groupBy("window_id").agg(F.max(F.col("at") + F.col("doc_to") - F.col("doc_from")).cast("int").alias("fill"))
    groups = -(-max(1, left.select("window_id").distinct().count()) // p.merge_group)
    targets = fills.repartition(groups, "window_id").mapInPandas(lean(merge), "window_id long, target long, shift int")
    moved = left.join(targets, "window_id").select(F.col("target").alias("window_id"), "doc_id", "doc_from", "doc_to", (F.col("at") + F.col("shift")).alias("at"), "tokens")
    return pieces.where("NOT is_open").drop("is_open").unionByName(moved)
