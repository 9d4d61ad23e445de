import threading
import time
from dataclasses import dataclass
from datetime import datetime, timedelta

import pytest

from tomewright.operators import log
from tomewright.operators.execute import Engine, set_json_field
from tomewright.operators.metrics import Samples
from tomewright.plans.boolean import QueryError
from tomewright.plans.commands import CommandError, Insert, Select, parse_command
from tomewright.sources.objects import Objects
from tomewright.sources.version_store import LOG, KeyNotFound, VersionStore, WriteConflict


class Clock:
    now = datetime(2024, 1, 1)

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "db"), clock=Clock())


def put(store, rows, **kw):
    return store.write("kv", store.spark.createDataFrame(rows, "key string, value string"), **kw)


def test_read_write_versions(store):
    first = put(store, [("k1", "v1"), ("a", "x")])
    assert store.read("kv", "k1") == "v1"
    put(store, [("k1", "v2")])
    assert store.read("kv", "k1") == "v2"
    assert store.read("kv", "k1", txn=first) == "v1"
    store.delete("kv", store.spark.createDataFrame([("k1",)], "key string"))
    with pytest.raises(KeyNotFound, match="key not found or expired"):
        store.read("kv", "k1")
    assert store.read("kv", "a") == "x"
    assert [r["key"] for r in store.cursor("kv", "a", "k1")] == ["a"]


def test_expired_newest_hides_older(store):
    put(store, [("k", "old")])
    put(store, [("k", "new")], ttl=timedelta(hours=1))
    assert store.read("kv", "k") == "new"
    store.clock.now = datetime(2024, 1, 1, 2)
    with pytest.raises(KeyNotFound):
        store.read("kv", "k")


def test_same_transaction_last_wins_and_empty_value(store):
    txn = store.begin()
    put(store, [("k", "")], txn=txn)
    assert store.read("kv", "k") == ""
    rows = store.spark.createDataFrame([("j", "1"), ("j", "2")], "key string, value string").coalesce(1)
    store.write("kv", rows)
    assert store.read("kv", "j") == "2"


def test_conflict(store):
    put(store, [("k", "1")])
    reader = store.snapshot_id()
    put(store, [("k", "2")])
    with pytest.raises(WriteConflict, match="Write conflict detected on key k"):
        put(store, [("k", "3")], read_txn=reader)
    assert store.read("kv", "k") == "2"


def test_uncommitted_is_invisible_and_recovery(store):
    put(store, [("k", "1")])
    lost = store.begin()
    store.spark.createDataFrame([("k", lost, 0, "9", None, False, None)], LOG).write.parquet(f"{store.root}/kv/generation=0/part=lost")
    assert store.read("kv", "k") == "1"
    again = VersionStore(store.spark, store.root, clock=store.clock)
    assert again.recover("kv") == (1, 1)
    assert again.begin() == lost + 1


def test_checkpoint(store):
    put(store, [("k", "1"), ("gone", "x")])
    put(store, [("k", "2")])
    store.delete("kv", store.spark.createDataFrame([("gone",)], "key string"))
    assert store.checkpoint("kv") == 1
    assert store.log("kv").count() == 1
    assert store.read("kv", "k") == "2"
    put(store, [("k", "3")])
    assert store.read("kv", "k") == "3"


def test_pipeline_of_commands(store):
    db = Engine(store, metrics=Samples())
    db.metrics.record("hit")
    db.metrics.record("miss")
    for i, text in enumerate(["cybersecurity research adversarial ai", "cryptography modular point transformer", "adversarial ai ethical inversion"], 1):
        db.execute(f"INSERT INTO docs VALUES ({i}, '{text}')")
    assert store.read("docs", "1") == "cybersecurity research adversarial ai"
    assert [r["doc_id"] for r in db.execute("SELECT * FROM docs WHERE adversarial AND ai").collect()] == [1, 3]
    assert db.execute("select from docs where adversarial limit 0").count() == 0
    db.execute("UPDATE docs SET text = 'all new' WHERE cryptography")
    assert [r["doc_id"] for r in db.execute("SELECT * FROM docs WHERE new").collect()] == [2]
    assert db.execute("SELECT * FROM docs WHERE cryptography").count() == 0
    db.execute("DELETE FROM docs WHERE ethical")
    assert [r["doc_id"] for r in db.execute("SELECT * FROM docs WHERE ai").collect()] == [1]
    db.execute("HSET user name 'Ann'")
    assert store.read("_hashes", "H:user:name") == "Ann"
    db.execute("INSERT INTO other VALUES (1, 'joined ai')")
    joined = db.execute("SELECT * FROM docs JOIN other ON docs.doc_id = other.doc_id WHERE ai").collect()
    assert [(r["doc_id"], r["right_text"]) for r in joined] == [(1, "joined ai")]
    assert "SUCCESS" in db.execute("RECOVER").first()["status"]
    assert "SUCCESS" in db.execute("CHECKPOINT").first()["status"]
    status = db.execute("SHOW METRICS").first()["status"]
    assert "hit ratio 50.00%" in status and "active transactions 1" in status
    assert [r["doc_id"] for r in db.execute("SELECT * FROM docs WHERE ai").collect()] == [1]


def test_compressed_and_json_field(store):
    db = Engine(store)
    db.execute("INSERT COMPRESSED INTO packed VALUES (1, 'secret words here')")
    assert store.read("packed", "1") != "secret words here"
    assert db.execute("SELECT COMPRESSED * FROM packed WHERE words").first()["text"] == "secret words here"
    db.execute("""INSERT INTO objects VALUES (1, '{"name": "ann", "role": "it''s"}')""")
    db.execute("UPDATE objects SET name = 'bob' WHERE ann")
    assert store.read("objects", "1") == """{"name": "bob", "role": "it's"}"""
    with pytest.raises(RuntimeError, match="telemetry interface is not active"):
        db.execute("SHOW METRICS")


@pytest.mark.parametrize(
    ("text", "error"),
    [("FLY", "unknown statement syntax mapping: FLY"), ("SHOW TABLES", "unexpected target after SHOW: TABLES"), ("SELECT a FROM t WHERE x", "expected FROM keyword"), ("SELECT * FROM t JOIN u WHERE x", "expected ON relationship match"), ("SELECT * FROM t", "missing conditional WHERE boundary"), ("INSERT INTO t (1)", "expected VALUES clause modifier entry flag"), ("INSERT INTO t VALUES (x, 'y')", "invalid insert identifier token: x"), ("UPDATE t SET a = 'b'", "expected WHERE parameter boundary definitions"), ("DELETE FROM t", "missing conditional parameters")],
)
def test_command_errors(text, error):
    with pytest.raises(CommandError) as e:
        parse_command(text)
    assert str(e.value) == error


def test_command_grammar():
    assert parse_command("INSERT INTO t VALUES (1, 'it''s')") == Insert("t", 1, "it's")
    assert parse_command("SELECT * FROM t WHERE x").limit == 100
    assert parse_command("SELECT * FROM t WHERE x LIMIT abc").limit == 100
    s = parse_command("select compressed * from a join b on a.x = b.y where p or q limit 5")
    assert isinstance(s, Select) and (s.join_table, s.join_left, s.join_right, s.limit, s.compressed) == ("b", "a.x", "b.y", 5, True)
    with pytest.raises(QueryError):
        parse_command("SELECT * FROM t WHERE (a AND b")


@dataclass
class UserProfile:
    id: int
    username: str
    role: str
    is_active: bool


@dataclass
class NoId:
    name: str


def test_object_lifecycle(store):
    db, user = Objects(store), UserProfile(42, "mara", "it's a Researcher", True)
    db.insert(user)
    assert db.find(UserProfile, 42) == user
    user.role, user.is_active = "Red Teamer", False
    db.update(user)
    assert db.find(UserProfile, 42) == user
    assert db.frame(UserProfile).first().asDict() == {"id": 42, "username": "mara", "role": "Red Teamer", "is_active": False}
    db.delete(user)
    with pytest.raises(KeyNotFound, match="record query failed"):
        db.find(UserProfile, 42)
    for wrong, error in (("text", "must be a dataclass"), (NoId("x"), "'id' field"), (UserProfile(-1, "", "", True), "unsigned integer")):
        with pytest.raises(TypeError, match=error):
            db.insert(wrong)


def test_scan_and_background_checkpoints(store):
    put(store, [("p1", "a"), ("p2", "b"), ("p3", "c"), ("q", "d")])
    seen = []
    assert store.scan("kv", "p", lambda k, v: seen.append((k, v)) or len(seen) < 2) == 2
    assert seen == [("p1", "a"), ("p2", "b")]
    store.start_checkpointer(0.1)
    deadline = time.time() + 60
    while store.generation("kv") == 0 and time.time() < deadline:
        time.sleep(0.1)
    store.close()
    assert store.generation("kv") >= 1 and store.read("kv", "q") == "d"


def test_own_statement(store):
    class CountRows:
        def run(self, engine):
            return engine.store.live("kv").groupBy().count()

    put(store, [("k", "1")])
    assert Engine(store).run(CountRows()).first()[0] == 1


def test_several_writes_of_a_transaction(store):
    """By one id one after the other, and together in a transaction, in which the later statement wins."""
    txn = store.begin()
    put(store, [("a", "1"), ("b", "1")], txn=txn)
    put(store, [("b", "2"), ("c", "2")], txn=txn)
    assert {r["key"]: r["value"] for r in store.live("kv").collect()} == {"a": "1", "b": "2", "c": "2"}
    with store.transaction() as t:
        put(store, [("a", "3"), ("d", "3")], txn=t)
        put(store, [("d", "4")], txn=t)
        store.write("other", store.spark.createDataFrame([("x", "1")], "key string, value string"), txn=t)
        assert store.read("kv", "a") == "1" and store.live("other").count() == 0
    assert {r["key"]: r["value"] for r in store.live("kv").collect()} == {"a": "3", "b": "2", "c": "2", "d": "4"}
    assert store.read("other", "x") == "1" and not store.active
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        put(store, [("a", "9")], txn=t)
        raise ZeroDivisionError
    assert store.read("kv", "a") == "3" and store.recover("kv")[1] == 1


def test_conflict_in_a_transaction(store):
    put(store, [("k", "1")])
    reader = store.snapshot_id()
    with pytest.raises(WriteConflict), store.transaction() as t:
        put(store, [("k", "2")], txn=t, read_txn=reader)
        put(store, [("k", "3")])
    assert store.read("kv", "k") == "3"


@pytest.mark.parametrize("step", ["_record", "_point", "_compact_commits"])
def test_checkpoint_that_fails_between_steps(store, monkeypatch, step):
    put(store, [("gone", "x"), ("k", "1")])
    with monkeypatch.context() as m:
        m.setattr(VersionStore, step, lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.checkpoint("kv")
    again = VersionStore(store.spark, store.root, clock=store.clock)
    again.delete("kv", store.spark.createDataFrame([("gone",)], "key string"))
    again.checkpoint("kv")
    again.checkpoint("kv")
    assert {r["key"]: r["value"] for r in again.live("kv").collect()} == {"k": "1"}
    put(again, [("k", "2")])
    assert again.vacuum() > 0 and {r["key"]: r["value"] for r in again.live("kv").collect()} == {"k": "2"}
    assert again.commits().count() == 2


def test_writes_race_checkpoints(store):
    put(store, [("start", "0")])
    with store.transaction() as t:
        put(store, [("staged", "1")], txn=t)
        store.checkpoint("kv")  # between the write and the commit
    done = threading.Event()

    def checkpoints():
        while not done.is_set():
            store.checkpoint("kv")

    other = threading.Thread(target=checkpoints)
    other.start()
    for i in range(6):
        put(store, [(f"k{i}", str(i))])
    done.set()
    other.join()
    assert {r["key"] for r in store.live("kv").collect()} == {"start", "staged", *(f"k{i}" for i in range(6))}


def test_locks_are_taken_and_released(store):
    class Locks:
        said = []

        def acquire(self, txn, key, mode):
            self.said.append((key, mode))

        def release(self, txn, key): ...

        def release_all(self, txn):
            self.said.append("released")

    store.locks = Locks()
    with store.transaction() as t:
        put(store, [("k", "1")], txn=t)
        store.live("kv", txn=t)
    assert Locks.said == [("kv", "X"), ("kv", "S"), "released"]


def test_recovery_reads_the_log_of_the_store(store):
    put(store, [("k", "1")])
    put(store, [("k", "2"), ("j", "1")])
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        put(store, [("k", "lost")], txn=t)
        raise ZeroDivisionError
    wal = store.wal("kv")
    assert {r["key"]: r["value"] for r in log.redo(wal).collect()} == {"k": "2", "j": "1"}
    assert [(r["key"], r["value"]) for r in log.undo(wal).collect()] == [("k", "2")]
    assert [r["txn_id"] for r in log.analysis(wal).collect()] == [t]
    assert len({r["lsn"] for r in wal.collect()}) == wal.count() == 6


def test_values_of_other_codecs_stay_raw(store):
    db = Engine(store)
    db.execute("INSERT INTO docs VALUES (1, 'hello123')")
    db.execute("INSERT COMPRESSED INTO docs VALUES (2, 'hello words')")
    store.write("docs", store.spark.createDataFrame([("3", "raw words", 0x48)], "key string, value string, codec int"))
    rows = db.execute("SELECT COMPRESSED * FROM docs WHERE hello123 OR words").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(1, "hello123"), (2, "hello words"), (3, "raw words")]


@pytest.mark.parametrize(
    ("text", "field", "out"),
    [('{"a": {"role": "x"}, "role" : 1.50 , "n":[1, 2]}', "role", '{"a": {"role": "x"}, "role" : "new" , "n":[1, 2]}'), ('{"a.b": 1, "ab": 2}', "a.b", '{"a.b": "new", "ab": 2}'), ("{}", "a", None), ('{"a": 1', "a", None), ("plain", "a", None), ('{"b": 1}', "a", None), ('{"a": "\\"a\\": 2"}', "a", '{"a": "new"}'), ('{"$1": "é"}', "$1", '{"$1": "new"}'), ('{"a": 1} x', "a", None)],
)
def test_json_fields(text, field, out):
    assert set_json_field(text, field, "new") == out
