"""Steps whose cost must not outgrow their input."""

import time

import pytest
from pyspark.sql import functions as F

from tomewright import queries
from tomewright.functions.codec import BlockCodec, RunPrefixCodec
from tomewright.operators import sets
from tomewright.sources import version_store
from tomewright.sources.indexed import IndexedDocuments


def seconds(act):
    began = time.perf_counter()
    act()
    return time.perf_counter() - began


def test_full_chunks_are_read_in_linear_time(spark):
    ids = spark.range(2 * 65536).select(F.col("id").alias("doc_id"))
    back = sets.from_chunks(sets.read_chunks(sets.serialised_chunks(ids)))
    assert seconds(lambda: back.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).collect()) < 30
    assert back.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()[:] == (131072, 131072, 0, 131071)


def test_block_codec_is_fast_per_byte():
    raw = b"A line of words, 12 of them; and a run of blanks      then more. " * 480
    codec = BlockCodec()
    assert codec.decode(codec.encode(raw)) == raw
    assert seconds(lambda: [codec.decode(codec.encode(raw)) for _ in range(20)]) < 20 * len(raw) * 1.5e-6


def test_block_codec_marks_among_runs():
    for raw in (b"\xfe", b"\xfe\x01" * 9, b"a" * 258 + b"\xfe" * 259, b"\xfe" * 254 + b"\xfd" * 254, b"abc" + bytes(510) + b"d", bytes(range(256)) * 127):
        packed = RunPrefixCodec().encode(raw)
        assert RunPrefixCodec().decode(packed) == raw
        with pytest.raises(ValueError, match="ends before"):
            RunPrefixCodec().decode(packed[:6])


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["postings_chunks", "postings_chunk_rows", "postings_delta", "postings_delta_decode"])
def test_postings_are_shuffled_once(spark, tmp_path, name):
    docs = spark.createDataFrame([(3, "b b a"), (1, "a c"), (2, "b")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert exchanges(queries.QUERIES[name](spark, str(tmp_path))) == 1


def test_recovery_cuts_long_transactions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(version_store, "PART_BITS", 3, raising=False)
    monkeypatch.setattr(version_store.VersionStore, "_commit", lambda *_: None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = version_store.VersionStore(spark, str(tmp_path / "store"))
        store.write("log", spark.range(200).selectExpr("CAST(id % 7 AS string) AS key", "CAST(id AS string) AS value"))
        wal = store.wal("log")
        assert wal.select(F.spark_partition_id()).distinct().count() > 1
        rows = wal.orderBy("txn_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [49 + len(r["key"]) + len(r["old_value"] or "") + len(r["new_value"]) for r in rows]
    assert [r["lsn"] for r in rows] == [sum(sizes[:i]) for i in range(200)]


def test_replaced_documents_drop_postings_by_document(spark, tmp_path):
    indexed = IndexedDocuments(version_store.VersionStore(spark, str(tmp_path / "store")), "docs")
    old = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "same")], "doc_id bigint, text string")
    new = spark.createDataFrame([(1, "blue white"), (2, None), (3, "same same")], "doc_id bigint, text string")
    gone = indexed._removed(old, new)
    assert sorted(r["key"] for r in gone.collect()) == ["term:green:doc:2", "term:red:doc:1", "term:red:doc:2"]
