"""Corpus preparation: toxic documents go, one of each group of near copies stays,
documents that hold the benchmark go, secrets are blotted out, and what is left is
packed into training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it back as the next stage's docs. The last one
gives the windows: rows of window_id, doc_id, doc_from, doc_to, at and tokens.

Defined results, for the chain as a whole: rows with null or empty text pass the filters,
and packing gives them no window; a row without a doc_id is judged by its text for
toxicity and near copies, passes decontamination (matches are told by doc_id) and is
packed under null; very long texts are read whole in every stage; of repeated rows one
stays, that of the smallest doc_id and then of the smallest hashes; ties are resolved
as the operators say; columns of documents pass all stages but the last untouched,
whatever their names (n_chars follows a redacted text); an empty table of documents gives
no windows; without labels nothing is toxic, without a benchmark nothing leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomewright.llm import decontaminate, ngram_join, packing, secrets, toxicity
from tomewright.llm.store import materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.reject(docs, read_table(spark, sf_dir, "benchmark"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", blot_secrets),
    ("packing", pack),
]

#: The stages train networks and tokenise, which SQL can't express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
