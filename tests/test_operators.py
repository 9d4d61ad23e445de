import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomewright.functions import codec, keys
from tomewright.operators import joins, log, metrics, ring, running, sets, versions
from tomewright.streaming import log_stream

LOG = "key string, txn_id bigint, seq bigint, value string, expires_at timestamp, deleted boolean"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9), st.booleans()), max_size=12), st.integers(0, 12))
def test_snapshot_is_replay(spark, writes, upto):
    rows = [(k, i, 0, str(v), None, d) for i, (k, v, d) in enumerate(writes)]
    state = {}
    for k, i, _, v, _, d in rows:
        if i <= upto:
            state[k] = None if d else v
    got = {r["key"]: r["value"] for r in versions.snapshot(spark.createDataFrame(rows, LOG), "2024-01-01", upto=upto).collect()}
    assert got == {k: v for k, v in state.items() if v is not None}


def test_ranges_and_images(spark):
    rows = [(k, i, 0, f"v{i}", None, False) for i, k in enumerate(["a", "ab", "b", "a", "c"])]
    frame = spark.createDataFrame(rows, LOG)
    assert [r["key"] for r in versions.scan_range(frame, "a", "b", "2024-01-01").collect()] == ["a", "ab", "b"]
    assert versions.scan_range(frame, "x", "z", "2024-01-01").count() == 0
    assert [r["key"] for r in versions.scan_prefix(frame, "a", "2024-01-01").collect()] == ["a", "ab"]
    assert {(r["key"], r["txn_id"]): r["old_value"] for r in versions.before_images(frame).collect()}[("a", 3)] == "v0"
    h = spark.createDataFrame([("H:u:x", 1, 0, "1", None, False), ("H:u:x", 2, 0, "2", None, False), ("H:u:y", 1, 0, "3", None, False), ("H:v:y", 1, 0, "4", None, False)], LOG)
    assert versions.hash_map(h, "u", "2024-01-01").first()["fields"] == {"x": "2", "y": "3"}


def test_joins(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, value int")
    b = spark.createDataFrame([("k", 7), ("k", 8), ("k", 9), ("n", 1)], "key string, value int")
    assert joins.merge_join(a, b).count() == 6
    assert sorted(map(tuple, joins.merge_join_zip(a, b).collect())) == [("k", 1, 7), ("k", 2, 8)]


def test_bitmaps(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "doc_id bigint") for ids in ([0, 65535, 65536, 5, 5], [5, 65536, 7]))
    assert sorted(map(tuple, sets.chunks(a).collect())) == [(0, 0), (0, 5), (0, 65535), (1, 0)]
    assert sorted(r[0] for r in sets.from_chunks(sets.chunks(a)).collect()) == [0, 5, 65535, 65536]
    x, y = sets.bitmaps(a), sets.bitmaps(b)
    assert [sets.size(m).first()["size"] for m in (x, y, sets.bitmap_union(x, y), sets.bitmap_intersect(x, y))] == [4, 3, 5, 2]
    assert sorted(r[0] for r in sets.difference(a, b).collect()) == [0, 65535]


def test_recovery(spark):
    rows = [(0, 1, "update", "a", None, "1"), (1, 2, "update", "a", "1", "2"), (2, 1, "commit", "", None, None), (3, 2, "update", "b", None, "9"), (4, 3, "update", "b", "9", "8"), (5, 3, "abort", "", None, None)]
    frame = spark.createDataFrame(rows, "n bigint, txn_id bigint, kind string, key string, old_value string, new_value string")
    wal = log.with_lsn(frame, log.record_size(F.col("key"), F.col("old_value"), F.col("new_value")), "n", F.lit(0)).cache()
    assert [r["lsn"] for r in wal.orderBy("n").collect()] == [0, 51, 103, 152, 203, 255]
    assert [r["prev_lsn"] for r in log.with_previous(wal).orderBy("n").collect()] == [None, None, 0, 51, None, 203]
    assert list(map(tuple, log.analysis(wal).collect())) == [(2, 152)]
    assert [(r["key"], r["value"]) for r in log.redo(wal).collect()] == [("a", "1")]
    assert sorted((r["key"], r["value"] or "") for r in log.undo(wal).collect()) == [("a", "1"), ("b", "")]
    signed = wal.withColumn("crc", codec.checksum(F.col("key"), F.col("old_value"), F.col("new_value")))
    assert log.verified(signed).count() == 6
    with pytest.raises(Exception, match="CRC mismatch at LSN 51"):
        log.verified(signed.withColumn("crc", F.when(F.col("n") == 1, 0).otherwise(F.col("crc")))).collect()


def test_ring(spark):
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    tokens = ring.ring_tokens(nodes)
    assert tokens.count() == 128
    places = sorted((r["hash"], r["node_id"]) for r in tokens.collect())
    owned = ring.owners(spark.range(50).select(F.col("id").cast("string").alias("key")), tokens).join(spark.range(50).select(F.col("id").cast("string").alias("key"), ring.ring_hash(F.col("id").cast("string")).alias("h")), "key").collect()
    for r in owned:
        assert r["node_id"] == next((n for h, n in places if h >= r["h"]), places[0][1])


def test_metrics_of_nothing(spark):
    row = metrics.metrics_snapshot(spark.createDataFrame([], "kind string, amount bigint")).first()
    assert (row["hits"], row["hit_ratio"], row["mean_flush"], row["active"]) == (0, 0.0, 0, 0)


def size_of(text):
    size = 0
    for _, n in codec.runs(text.encode()):
        size += n // 255 * 3 + (3 if n % 255 >= 4 else n % 255)
    return size


def test_codecs(spark):
    texts = ["a", "aaaa", "a" * 600, "Abc: \"x\" _1!", "", None, "xyyyyyz" * 9]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    packed = frame.select("id", "text", codec.enveloped(F.col("text"), codec.ZlibCodec()).alias("p"))
    assert packed.where(~codec.opened(F.col("p"), codec.ZlibCodec()).cast("string").eqNullSafe(F.col("text"))).count() == 0
    assert codec.checksum(F.lit("abc")) is not None
    assert spark.range(1).select(codec.checksum(F.lit("abc"))).first()[0] == zlib.crc32(b"abc")
    for r in frame.select("text", codec.run_length_size(F.col("text")).alias("n"), codec.prefix_code_bits(F.col("text")).alias("bits")).collect():
        if r["text"] is not None:
            assert r["n"] == size_of(r["text"])
            assert r["bits"] == sum(codec.code_length(b) for b in r["text"].encode())
    with pytest.raises(Exception, match="mismatched compression codec"):
        packed.select(codec.opened(F.col("p"), codec.RunPrefixCodec())).collect()
    assert spark.range(1).select(keys.big_endian(F.lit(258), 4)).first()[0] == "0102"
    assert Counter(n for _, n in codec.CODES.values()) == {7: 37, 8: 29, 9: 190}


@given(st.binary(min_size=1, max_size=400))
def test_block_codec(raw):
    c = codec.RunPrefixCodec()
    assert c.decode(c.encode(raw)) == raw


def test_block_codec_limits():
    for raw in (b"", b"x" * 32701):
        with pytest.raises(ValueError, match="invalid compression parameters"):
            codec.RunPrefixCodec().encode(raw)


def test_streams(spark, tmp_path):
    rows = [("a", 1, "x", "2024-01-01 00:00:00", 0, False), ("a", 2, "y", "2024-01-01 00:00:10", 5, False), ("b", 3, "z", "2024-01-01 00:01:00", 0, False)]
    frame = spark.createDataFrame(rows, "key string, txn_id bigint, value string, ts string, ttl_seconds bigint, deleted boolean").withColumn("ts", F.to_timestamp("ts"))
    for part in frame.select("txn_id").collect():
        frame.where(F.col("txn_id") == part[0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = log_stream.log_source(spark, str(tmp_path / "in"), frame.schema)
    log_stream.group_commit(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert log_stream.committed(spark, str(tmp_path / "out")).count() == 3
    live = log_stream.latest_versions(log_stream.log_source(spark, str(tmp_path / "in"), frame.schema))
    q = live.writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [(r["key"], r["txn_id"], r["live"]) for r in spark.table("latest").collect()]
    assert ("a", 2, True) in seen and ("b", 3, True) in seen


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(-5, 5)), unique_by=lambda r: r[:2], max_size=20))
def test_running_sums_and_gaps(spark, rows):
    frame = spark.createDataFrame(rows, "k string, n bigint, v bigint")
    part = F.floor(F.col("n") / 7)
    got = {(r["k"], r["n"]): r["s"] for r in running.running_sums(frame, "n", part, ["k"], s="v").collect()}
    before = {(r["k"], r["n"]): r["p"] for r in running.previous(frame, "n", part, ["k"], "p").collect()}
    assert len(got) == len(before) == len(rows)
    for k, n, _ in rows:
        assert got[k, n] == sum(v for a, m, v in rows if a == k and m <= n)
        assert before[k, n] == max((m for a, m, _ in rows if a == k and m < n), default=None)
