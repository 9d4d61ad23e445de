"""Collections kept as append-only version logs in Parquet.

    <root>/<collection>/generation=<g>/part=<p>/   rows of one write
    <root>/_commits.../                            a row a part of a committed transaction
    <root>/_current/                               a row a checkpoint: table, number, generation

A write appends rows as a part of its own. A commit adds the records of all parts of a
transaction in one file, so they become visible together; readers take committed parts of
the current generation only. A half-written transaction is never seen, and recovery has
nothing to repair. A checkpoint writes a compacted generation under a name that was never
used and then points at it, so one that fails between any two steps changes nothing; it
compacts the commit records in the same way. Transaction ids come from the driver, the
only writer: checks, commits and checkpoints hold its mutex.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.log import record_size, with_lsn
from tomewright.operators.versions import before_images, conflicts, snapshot

LOG = "key string, txn_id bigint, seq bigint, value string, expires_at timestamp, deleted boolean, codec int"
COLUMNS = [x.split()[0] for x in LOG.split(", ")]
COMMITS = "txn_id bigint, collection string, generation string, part string, committed_at timestamp"
#: Rows of one statement; those of the next one in a transaction are later.
STATEMENT = 1 << 52
#: 2**PART_BITS rows in a row of one task of a statement are ordered by one task of recovery.
PART_BITS = 18
CONFLICT = "OCC SERIALIZATION ISOLATION FAILURE: Write conflict detected on key {}"


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class KeyNotFound(KeyError):
    """No live version of a key is visible."""


class WriteConflict(RuntimeError):
    """Another transaction committed a later version of a key first."""


class LockManager(Protocol):
    """Extension point: shared (S) and exclusive (X) locks of a transaction."""

    def acquire(self, txn: int, key: str, mode: str) -> None: ...

    def release(self, txn: int, key: str) -> None: ...

    def release_all(self, txn: int) -> None: ...


class KeyValueStore(Protocol):
    """Extension point: what the command engine asks of a store."""

    def begin(self) -> int: ...

    def live(self, collection: str, txn: int | None = None) -> DataFrame: ...

    def read(self, collection: str, key: str, txn: int | None = None) -> str: ...

    def write(self, collection: str, rows: DataFrame, txn: int | None = None) -> int: ...

    def delete(self, collection: str, keys: DataFrame, txn: int | None = None) -> int: ...

    def scan(self, collection: str, prefix: str, visit: Callable[[str, str], bool], txn: int | None = None) -> int: ...


@dataclass(frozen=True)
class Part:
    """Rows that a transaction wrote and may not have committed yet."""

    collection: str
    generation: str
    name: str
    read_txn: int | None


@dataclass
class VersionStore:
    spark: SparkSession
    root: str
    clock: Callable[[], datetime] = utc_now
    locks: LockManager | None = None
    active: set[int] = field(default_factory=set)
    _mutex: threading.RLock = field(default_factory=threading.RLock)
    _last: int | None = None
    _staged: dict[int, list[Part]] = field(default_factory=dict)
    _statements: dict[int, int] = field(default_factory=dict)
    _closing: threading.Event = field(default_factory=threading.Event)
    _checkpointer: threading.Thread | None = None

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _pointer(self, name: str) -> tuple[int, str]:
        """(number, generation) that is current for a collection, or for the commit records."""
        found = self._table("_current", "name string, number bigint, generation string").where(F.col("name") == name).agg(F.max(F.struct("number", "generation"))).first()[0]
        return (found["number"], found["generation"]) if found else (0, "0")

    def _point(self, name: str, number: int, generation: str) -> None:
        row = self.spark.createDataFrame([(name, number, generation)], "name string, number bigint, generation string")
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_current")

    def _commit_folder(self) -> str:
        return f"_commits-{self._pointer('_commits')[1]}"

    def commits(self) -> DataFrame:
        return self._table(self._commit_folder(), COMMITS)

    def generation(self, collection: str) -> int:
        """Number of checkpoints of a collection."""
        return self._pointer(collection)[0]

    def _parts(self, collection: str) -> DataFrame:
        """All rows of the current generation with their part, committed or not."""
        path = f"{self.root}/{collection}/generation={self._pointer(collection)[1]}"
        return self.spark.read.schema(f"{LOG}, part string").parquet(path) if self._exists(path) else self.spark.createDataFrame([], f"{LOG}, part string")

    def log(self, collection: str) -> DataFrame:
        """All committed versions of a collection."""
        done = self.commits().where(F.col("collection") == collection).select("part")
        return self._parts(collection).join(F.broadcast(done), "part", "left_semi").select(*COLUMNS)  # as many rows as writes since the last checkpoint

    def wal(self, collection: str) -> DataFrame:
        """The log as recovery reads it: lsn, txn_id, kind, key, old_value, new_value; of all transactions, those without a commit too."""
        every = before_images(self._parts(collection)).select("txn_id", "seq", F.lit("update").alias("kind"), "key", "old_value", F.col("value").alias("new_value"), "deleted", "expires_at")
        none = F.lit(None).cast("string")
        ends = self.commits().where(F.col("collection") == collection).select("txn_id").distinct()
        ends = ends.select("txn_id", F.lit(2**63 - 1).alias("seq"), F.lit("commit").alias("kind"), F.lit("").alias("key"), none.alias("old_value"), none.alias("new_value"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("expires_at"))
        rows = every.unionByName(ends).withColumn("at", F.struct("txn_id", "seq", "key"))
        part = F.struct("txn_id", F.shiftright("seq", PART_BITS).alias("rows"))  # a transaction may hold most of the log, so its rows are cut as well
        return with_lsn(rows, record_size(F.col("key"), F.col("old_value"), F.col("new_value")), "at", part).drop("at")

    def begin(self) -> int:
        """A new transaction id, above all that were ever committed."""
        with self._mutex:
            if self._last is None:
                self._last = self.commits().agg(F.max("txn_id")).first()[0] or 0
            self._last += 1
            self.active.add(self._last)
            return self._last

    def snapshot_id(self) -> int:
        """The newest transaction that a reader who starts now sees."""
        with self._mutex:
            return self.begin_reader()

    def begin_reader(self) -> int:
        return (self.commits().agg(F.max("txn_id")).first()[0] or 0) if self._last is None else self._last

    @contextmanager
    def transaction(self) -> Iterator[int]:
        """A transaction of several writes (pass its id to them). They become visible together at the end, or not at all if it fails."""
        txn = self.begin()
        self._staged[txn] = []
        try:
            yield txn
            self._commit(txn, self._staged[txn])
        finally:
            self._staged.pop(txn, None)
            self._end(txn)

    def _end(self, txn: int) -> None:
        self.active.discard(txn)
        if self.locks is not None:
            self.locks.release_all(txn)

    def write(self, collection: str, rows: DataFrame, txn: int | None = None, ttl: timedelta | None = None, read_txn: int | None = None) -> int:
        """Appends (key, value[, deleted, codec]). With read_txn, the commit fails if a key has a later version than that reader saw.
        Outside of transaction() the write is committed at once."""
        txn = self.begin() if txn is None else txn
        staged = self._staged.get(txn)
        try:
            if self.locks is not None:
                self.locks.acquire(txn, collection, "X")
            with self._mutex:
                part = self._append(collection, rows, txn, self.clock() + ttl if ttl else None, read_txn)
                if staged is None:
                    self._commit(txn, [part])
                else:
                    staged.append(part)
            return txn
        finally:
            if staged is None:
                self._end(txn)

    def _append(self, collection: str, rows: DataFrame, txn: int, expires: datetime | None, read_txn: int | None) -> Part:
        n = self._statements[txn] = self._statements.get(txn, -1) + 1
        given = {"deleted": F.lit(False), "codec": F.lit(None)} | {c: F.col(c) for c in ("deleted", "codec") if c in rows.columns}
        out = rows.select(F.col("key").cast("string").alias("key"), F.lit(txn).cast("bigint").alias("txn_id"), (F.lit(n * STATEMENT) + F.monotonically_increasing_id()).alias("seq"), F.col("value").cast("string").alias("value"), F.lit(expires).cast("timestamp").alias("expires_at"), given["deleted"].alias("deleted"), given["codec"].cast("int").alias("codec"))
        part = Part(collection, self._pointer(collection)[1], uuid.uuid4().hex, read_txn)
        out.sortWithinPartitions("key").write.parquet(f"{self.root}/{collection}/generation={part.generation}/part={part.name}")
        return part

    def _rows(self, part: Part) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.root}/{part.collection}/generation={part.generation}/part={part.name}")

    def _commit(self, txn: int, parts: list[Part]) -> None:
        """Checks the write set and adds the commit records of all parts in one file."""
        with self._mutex:
            records = []
            for part in parts:
                if part.read_txn is not None:
                    clash = conflicts(self._rows(part), self.log(part.collection), part.read_txn, txn).orderBy("key").first()
                    if clash:
                        raise WriteConflict(CONFLICT.format(clash["key"]))
                now = self._pointer(part.collection)[1]
                if now != part.generation:  # a checkpoint came between the write and the commit
                    self._rows(part).write.parquet(f"{self.root}/{part.collection}/generation={now}/part={part.name}")
                records.append((txn, part.collection, now, part.name, self.clock()))
            self._record(records, self._commit_folder())

    def _record(self, records: list[tuple], folder: str) -> None:
        if records:
            self.spark.createDataFrame(records, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/{folder}")

    def delete(self, collection: str, keys: DataFrame, txn: int | None = None) -> int:
        """Appends a tombstone for every key."""
        return self.write(collection, keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted")), txn)

    def live(self, collection: str, txn: int | None = None, moment: str | Column | None = None) -> DataFrame:
        """(key, value) that a reader sees."""
        return self.versions(collection, txn, moment).select("key", "value")

    def versions(self, collection: str, txn: int | None = None, moment: str | Column | None = None) -> DataFrame:
        """The versions that a reader sees, with all columns of the log."""
        if self.locks is not None and txn in self.active:
            self.locks.acquire(txn, collection, "S")
        at = F.lit(self.clock()).cast("timestamp") if moment is None else moment
        return snapshot(self.log(collection), at, upto=txn)

    def read(self, collection: str, key: str, txn: int | None = None) -> str:
        row = self.live(collection, txn).where(F.col("key") == key).first()
        if row is None:
            raise KeyNotFound("key not found or expired within slotted scope")
        return row["value"]

    def cursor(self, collection: str, start: str, end: str, txn: int | None = None):
        """Rows with start <= key <= end in order, one partition at a time on the driver; stop when you like."""
        return self.live(collection, txn).where(F.col("key").between(start, end)).orderBy("key").toLocalIterator()

    def scan(self, collection: str, prefix: str, visit: Callable[[str, str], bool], txn: int | None = None) -> int:
        """Calls visit(key, value) for live keys with the prefix in ascending order until it gives False; the number of calls."""
        calls = 0
        for row in self.live(collection, txn).where(F.col("key").startswith(prefix)).orderBy("key").toLocalIterator():
            calls += 1
            if visit(row["key"], row["value"]) is False:
                break
        return calls

    def start_checkpointer(self, seconds: float = 300.0) -> None:
        """Checkpoints all collections every so many seconds until close()."""

        def loop() -> None:
            while not self._closing.wait(seconds):
                for name in self.collections():
                    self.checkpoint(name)

        self._closing.clear()
        self._checkpointer = threading.Thread(target=loop, name="checkpointer", daemon=True)
        self._checkpointer.start()

    def close(self) -> None:
        """Stops background work."""
        self._closing.set()
        if self._checkpointer is not None:
            self._checkpointer.join()
            self._checkpointer = None

    def hset(self, name: str, field_: str, value: str, ttl: timedelta | None = None) -> int:
        """Sets one field of a hash."""
        return self.write("_hashes", self.spark.createDataFrame([(f"H:{name}:{field_}", value)], "key string, value string"), ttl=ttl)

    def checkpoint(self, collection: str) -> int:
        """Writes the live versions as a new generation and points readers at it; compacts the commit records."""
        with self._mutex:
            number = self._pointer(collection)[0] + 1
            kept = snapshot(self.log(collection), F.lit(self.clock()).cast("timestamp"))
            txn, generation, part = self.begin(), uuid.uuid4().hex, uuid.uuid4().hex
            kept.repartitionByRange("key").sortWithinPartitions("key").select(*COLUMNS).write.parquet(f"{self.root}/{collection}/generation={generation}/part={part}")
            self._record([(txn, collection, generation, part, self.clock())], self._commit_folder())
            self._point(collection, number, generation)
            self.active.discard(txn)
            self._compact_commits()
            return number

    def _compact_commits(self) -> None:
        """Leaves the commit records of current generations, in one new file."""
        current = self._table("_current", "name string, number bigint, generation string").groupBy("name").agg(F.max(F.struct("number", "generation")).alias("c"))
        current = current.select(F.col("name").alias("collection"), F.col("c.generation").alias("now"))
        kept = self.commits().join(F.broadcast(current), "collection", "left").where("generation = coalesce(now, '0')").drop("now")  # a row a collection
        number, generation = self._pointer("_commits")[0] + 1, uuid.uuid4().hex
        kept.coalesce(1).write.parquet(f"{self.root}/_commits-{generation}")
        self._point("_commits", number, generation)

    def vacuum(self) -> int:
        """Removes the folders of generations that are no longer current; what was read from them must be done. The number of folders."""
        with self._mutex:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            root = hadoop.Path(self.root)
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            gone = [x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("_commits-") and x.getPath().getName() != self._commit_folder()]
            for name in self.collections():
                now = f"generation={self._pointer(name)[1]}"
                gone += [x.getPath() for x in fs.listStatus(hadoop.Path(f"{self.root}/{name}")) if x.getPath().getName() != now]
            for path in gone:
                fs.delete(path, True)
            return len(gone)

    def recover(self, collection: str) -> tuple[int, int]:
        """(committed, lost): transactions with and without a commit record. Lost ones are invisible already; numbering goes on above both."""
        done = self.commits().where(F.col("collection") == collection)
        lost = self._parts(collection).join(F.broadcast(done.select("part")), "part", "left_anti").agg(F.countDistinct("txn_id").alias("n"), F.max("txn_id").alias("top")).first()
        with self._mutex:
            self._last = max(self._last or 0, self.commits().agg(F.max("txn_id")).first()[0] or 0, lost["top"] or 0)
            self.active.clear()
        return done.select("txn_id").distinct().count(), lost["n"]

    def collections(self) -> list[str]:
        """Names of the collections with committed rows."""
        return sorted(r["collection"] for r in self.commits().select("collection").distinct().collect())
