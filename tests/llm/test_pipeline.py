"""The pipeline and the registered queries, on the smallest tables and on a fixture with known answers."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tomewright.llm import decontaminate, ngram_join, secrets, toxicity
from tomewright.llm.queries import ORACLES, QUERIES
from tomewright.llm.store import read_table

from .conftest import DOCS, prose
from .test_toxicity import toxic

FOLDER = "/root/testdata/sf0.001"
TOKEN = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, toxic(i, 60 + i % 90) if i % 4 == 0 else prose(i, 60 + i % 90), "en") for i in range(600)]
    rows += [(700, prose(1, 61), "en"), (701, prose(1, 61) + " more", "en"), (710, prose(900, 80) + " " + prose(950, 30), "en"), (711, f'{prose(901, 40)} token = "{TOKEN}" {prose(902, 40)}', "en"), (720, None, None), (721, "", "en"), (None, prose(903, 50), "en")]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(950, 30))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    """Each stage against what its operator finds in the stage's own input."""
    docs, named = read_table(spark, folder, "documents"), dict(corpus_pipeline.STAGES)
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    columns = docs.columns
    clean = named["toxicity"](spark, docs, folder).cache()
    assert ids(docs) - ids(clean) == {r["doc_id"] for r in toxicity.flag(docs, read_table(spark, folder, "labels")).collect()}
    assert sum(i % 4 == 0 for i in ids(docs) - ids(clean) if i < 600) > 130
    one = named["near_duplicates"](spark, clean, folder).cache()
    assert ids(clean) - ids(one) == {r["doc_id"] for r in ngram_join.linked(clean).where("doc_id <> class_id").collect()} == {700, 701}
    pure = named["decontamination"](spark, one, folder).cache()
    assert ids(one) - ids(pure) == {r["doc_id"] for r in decontaminate.leaks(one, read_table(spark, folder, "benchmark")).collect()} == {710}
    blank = named["secrets"](spark, pure, folder).cache()
    assert ids(blank) == ids(pure) and {720, 721, None} <= ids(blank)
    assert secrets.scan(pure).count() == 1 and secrets.scan(blank).count() == 0
    for d in (clean, one, pure, blank):
        assert d.columns == columns
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in blank.where("length(text) > 0").collect()}


def packed_ids(spark, at, docs, labels, benchmark):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(at)).collect())


def test_odd_tables(spark, tmp_path, make_docs, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, clashing names, and empty tables, through the whole chain."""
    assert packed_ids(spark, tmp_path / "none", no_docs, [], []) == []
    item = [(1, prose(3, 120)), (None, "x"), (2, None), (3, "")]
    got = set(packed_ids(spark, tmp_path / "odd", odd_docs, [(None, None, None), (5, 1, 0)], item))
    assert got == {"4", "5", "7", "8", "None"}  # 6 and 9 hold the item, 1 and 3 have no tokens
    twice = make_docs([(7, prose(1, 60)), (7, prose(2, 60)), (8, prose(2, 60)), (None, prose(1, 60))], extra=True)
    assert packed_ids(spark, tmp_path / "twice", twice, [], []) == ["7", "7"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert name in entry.queries()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("pages", "documents"):
            path = f"{FOLDER}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
        want = con.sql(ORACLES[name]).df()
        key = lambda d: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
        assert key(got) == key(want)
