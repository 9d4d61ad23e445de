import json
import math

import pytest

from tomewright.functions.text import analyze, ascii_tokens, first_ascii_token, unicode_tokens
from tomewright.operators import index, search

CORPUS = [("doc-a", "critical adversarial ai anomaly verified"), ("doc-b", "hardware tpm authentication loop initiated")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_tokenizers(spark):
    row = spark.createDataFrame([("The Straße of 42, x Über-alles! ÄB",)], "text string").select(ascii_tokens("text").alias("a"), unicode_tokens("text").alias("u")).first()
    assert row["a"] == ["the", "stra", "e", "of", "42", "x", "ber", "alles", "b"]
    assert row["u"] == ["straße", "42", "über", "alles", "äb"]
    assert analyze("The Straße of 42, x Über-alles!") == ["straße", "42", "über", "alles"]
    assert first_ascii_token("(Threat_level") == "threat"


def test_ranked_search(spark):
    hits = search.search(frame(spark, CORPUS), "adversarial ai", 10).collect()
    assert [h["doc_id"] for h in hits] == ["doc-a"]
    assert hits[0]["score"] == pytest.approx(2 * math.log(2))


def test_words_that_repeat_score_twice(spark):
    docs = frame(spark, [*CORPUS, ("doc-c", "adversarial")])
    once, twice = (search.search(docs, q, 0).where("doc_id = 'doc-c'").first()["score"] for q in ("adversarial", "adversarial adversarial"))
    assert twice == pytest.approx(2 * once)


def test_ties_and_limit(spark):
    docs = frame(spark, [(f"d{i}", "same words") for i in range(5)])
    assert [r["doc_id"] for r in search.search(docs, "same", 3).collect()] == ["d0", "d1", "d2"]
    assert search.search(docs, "same", 0).count() == 5
    assert search.search(docs, "the", 3).count() == 0


class Policy:
    def __init__(self, allowed):
        self.allowed, self.seen = allowed, []

    def verify_access(self, subject, action, target):
        return self.allowed

    def log_audit(self, subject, action, allowed):
        self.seen.append((subject, action, allowed))


def test_scatter_gather(spark):
    docs = spark.createDataFrame([("doc-local", "critical threat detected", "n1")], "doc_id string, text string, site string")
    remote = spark.createDataFrame([("remote-doc-99", 8.5)], "doc_id string, score double")
    policy = Policy(True)
    hits = search.scatter_gather(docs, "critical threat", 10, "site", "me", policy, remote).collect()
    assert [h["doc_id"] for h in hits] == ["remote-doc-99", "doc-local"]
    assert hits[1]["score"] == pytest.approx(2 * math.log(4 / 3))
    assert policy.seen == [("me", "search", True)]
    denied = Policy(False)
    with pytest.raises(PermissionError, match="security policy validation failure"):
        search.scatter_gather(docs, "critical", 10, "site", "me", denied)
    assert denied.seen == [("me", "search", False)]


@pytest.mark.parametrize("n", [255, 256, 257, 600])
def test_chunks(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "'word' AS text")
    rows = index.chunk_rows(index.term_frequencies(docs)).orderBy("chunk_id").collect()
    assert [len(r["postings"]) for r in rows] == [256] * (n // 256) + ([n % 256] if n % 256 else [])


def test_deltas_and_segment(spark, tmp_path):
    docs = spark.createDataFrame([(i * i * 50, f"w{i % 3} all") for i in range(40)], "doc_id bigint, text string")
    posted = index.postings(docs).cache()
    gaps = index.delta_encode(posted).selectExpr("term", "delta", "CAST(row_number() OVER (PARTITION BY term ORDER BY doc_id) AS BIGINT) AS position")
    assert sorted(index.delta_decode(gaps).select("term", "doc_id").collect()) == sorted(posted.select("term", "doc_id").collect())
    index.write_segment(posted, str(tmp_path / "segment"))
    stored = spark.read.parquet(str(tmp_path / "segment"))
    assert [r["doc_id"] for r in index.fetch_postings(stored, "w1").collect()] == [i * i * 50 for i in range(40) if i % 3 == 1]
    assert index.fetch_postings(stored, "unknown").count() == 0
    rows = index.segment_dictionary(posted).orderBy("term").collect()
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["bytes"]


def test_remote_sites(spark):
    class Sites:
        def broadcast_query(self, query_json):
            assert json.loads(query_json)["limit"] == 10
            return ['[{"doc_id": "remote-doc-99", "score": 8.5}]', "not json", '[{"no": 1}]']

    docs = spark.createDataFrame([("doc-local", "critical threat detected", "n1")], "doc_id string, text string, site string")
    hits = search.scatter_gather(docs, "critical threat", 10, "site", remote=search.remote_hits(spark, Sites(), "critical threat", 10)).collect()
    assert [h["doc_id"] for h in hits] == ["remote-doc-99", "doc-local"]
