"""Runs commands: as pure functions over documents, and by an engine over a version store."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.codec import Codec, ZlibCodec, enveloped, opened
from tomewright.plans import commands as C
from tomewright.sources.version_store import VersionStore

from .joins import equi_join
from .metrics import Samples, metrics_snapshot, report
from .search import scan_condition, select_documents

DONE = "SUCCESS"


def inserted(docs: DataFrame, statement: C.Insert) -> DataFrame:
    """(doc_id, text) after an insert; an existing id gets the new text."""
    row = docs.sparkSession.createDataFrame([(statement.doc_id, statement.text)], "doc_id bigint, text string")
    return docs.select("doc_id", "text").where(F.col("doc_id") != statement.doc_id).unionByName(row)


def updated(docs: DataFrame, statement: C.Update) -> DataFrame:
    """Matching documents get the value as their text."""
    hit = scan_condition(statement.where)
    return docs.withColumn("text", F.when(hit, F.lit(statement.value)).otherwise(F.col("text")))


def deleted(docs: DataFrame, statement: C.Delete) -> DataFrame:
    return docs.where(~scan_condition(statement.where))


def selected(docs: DataFrame, statement: C.Select, other: DataFrame | None = None) -> DataFrame:
    """Matching documents by ascending doc_id, joined with the other table if the statement names one."""
    if statement.join_table is None:
        return select_documents(docs, statement.where, statement.limit)
    column = lambda name: name.rpartition(".")[2]
    hit = docs.where(scan_condition(statement.where))
    joined = equi_join(hit, other, column(statement.join_left), column(statement.join_right))
    return joined.orderBy("doc_id", *[c for c in joined.columns if c != "doc_id"]).limit(max(0, statement.limit))


def set_json_field(text: str, name: str, value: str) -> str | None:
    """A JSON object with a top-level field set to a string; everything else stays as it was written. None if there is no such field."""
    decode, space = json.JSONDecoder().raw_decode, re.compile(r"[ \t\n\r]*")
    skip = lambda i: space.match(text, i).end()
    out, last = [], 0
    try:
        i = skip(0)
        if text[i] != "{":
            return None
        i = skip(i + 1)
        while text[i] != "}":
            key, i = decode(text, i)
            i = skip(i)
            if not isinstance(key, str) or text[i] != ":":
                return None
            start = skip(i + 1)
            _, end = decode(text, start)
            if key == name:
                out += [text[last:start], json.dumps(value, ensure_ascii=False)]
                last = end
            i = skip(end)
            if text[i] == ",":
                i = skip(i + 1)
        if skip(i + 1) != len(text):
            return None
    except (ValueError, IndexError):
        return None
    return "".join(out) + text[last:] if out else None


def with_field(text: Column, name: str, value: str) -> Column:
    """The text with the field set, if it is a JSON object that has the field; else the value."""

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: set_json_field(t, name, value))

    return F.coalesce(put(F.when(text.startswith("{"), text).otherwise(F.lit(""))), F.lit(value))


@dataclass
class Engine:
    """Commands over collections. A collection's text is its value; ids are its keys."""

    store: VersionStore
    codec: Codec = field(default_factory=ZlibCodec)
    metrics: Samples | None = None

    def documents(self, table: str, compressed: bool = False) -> DataFrame:
        """(doc_id, text). compressed: values that were stored by this engine's codec are unpacked; those of others stay as they are."""
        rows = self.store.versions(table).select(F.col("key").cast("bigint").alias("doc_id"), F.col("value").alias("text"), "codec")
        if not compressed:
            return rows.drop("codec")
        own = F.coalesce(F.col("codec") == self.codec.id, F.lit(False))
        packed = opened(F.when(own, F.unbase64("text")), self.codec)
        return rows.select("doc_id", F.when(own, packed.cast("string")).otherwise(F.col("text")).alias("text"))

    def execute(self, text: str) -> DataFrame:
        return self.run(C.parse_command(text))

    def run(self, statement: C.Statement) -> DataFrame:
        """A statement of the language, or any object with run(engine) -> DataFrame."""
        own = getattr(statement, "run", None)
        began = time.monotonic_ns()
        if self.metrics is not None:
            self.metrics.record("begin")
        try:
            return own(self) if own else getattr(self, f"_{type(statement).__name__.lower()}")(statement)
        finally:
            if self.metrics is not None:
                self.metrics.record("end")
                if isinstance(statement, (C.Insert, C.Update, C.Delete, C.HashSet)):
                    self.metrics.record("flush", time.monotonic_ns() - began)
                elif isinstance(statement, C.Checkpoint):
                    self.metrics.record("compaction", time.monotonic_ns() - began)

    def _say(self, status: str) -> DataFrame:
        return self.store.spark.createDataFrame([(status,)], "status string")

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.store.spark.createDataFrame(rows, "key string, value string")

    def _select(self, s: C.Select) -> DataFrame:
        other = self.documents(s.join_table) if s.join_table else None
        return selected(self.documents(s.table, s.compressed), s, other)

    def _insert(self, s: C.Insert) -> DataFrame:
        rows = self._rows([(str(s.doc_id), s.text)])
        if s.compressed:
            rows = rows.select("key", F.base64(enveloped(F.col("value"), self.codec)).alias("value"), F.lit(self.codec.id).alias("codec"))
        self.store.write(s.table, rows)
        return self._say(f"{DONE}: document {s.doc_id} stored")

    def _hits(self, table: str, where) -> DataFrame:
        return self.documents(table).where(scan_condition(where)).select(F.col("doc_id").cast("string").alias("key"), "text")

    def _update(self, s: C.Update) -> DataFrame:
        """The whole value of a text; one field of a JSON object."""
        read_txn = self.store.snapshot_id()
        hits = self._hits(s.table, s.where)
        rows = hits.select("key", with_field(F.col("text"), s.field, s.value).alias("value"))
        self.store.write(s.table, rows, read_txn=read_txn)
        return self._say(f"{DONE}: matching documents updated")

    def _delete(self, s: C.Delete) -> DataFrame:
        self.store.delete(s.table, self._hits(s.table, s.where).select("key"))
        return self._say(f"{DONE}: matching documents deleted")

    def _hashset(self, s: C.HashSet) -> DataFrame:
        self.store.hset(s.name, s.field, s.value)
        return self._say(f"{DONE}: field {s.field} of {s.name} set")

    def _recover(self, s: C.Recover) -> DataFrame:
        found = [self.store.recover(c) for c in self.store.collections()]
        return self._say(f"{DONE}: {sum(a for a, _ in found)} transactions kept, {sum(b for _, b in found)} rolled back")

    def _checkpoint(self, s: C.Checkpoint) -> DataFrame:
        names = self.store.collections()
        for name in names:
            self.store.checkpoint(name)
        return self._say(f"{DONE}: {len(names)} collections checkpointed")

    def _showmetrics(self, s: C.ShowMetrics) -> DataFrame:
        if self.metrics is None:
            raise RuntimeError("telemetry interface is not active on this runtime instance")
        return report(metrics_snapshot(self.metrics.frame(self.store.spark)))
