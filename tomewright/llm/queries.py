"""Queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, ngram_join, packing, quality, secrets, substring_dedup, toxicity, url_filter, warc, wavelet
from .store import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality model keeps."""
    return quality.keep(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret found in the documents."""
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on the URL of every page."""
    return url_filter.decide(read_table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as wavelet matrix shards, read back document by document."""
    return wavelet.tokenise(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold phrases of the benchmark or come near one."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training windows that the documents' tokens go to."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose word n-gram set is like another's: its group and the number of its links."""
    return ngram_join.linked(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for toxic."""
    return toxicity.flag(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that several documents hold."""
    return substring_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read back."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_secret_scans, op3_url_filters, op4_token_output, op5_decontamination, op6_packing, op7_ngram_join, op8_toxicity, op9_substring_dedup, op10_warc)
}

ORACLES: dict[str, str] = {
    "op3_url_filters": url_filter.oracle(),
    "op9_substring_dedup": substring_dedup.oracle(),
    "op10_warc": "SELECT page_id, url, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, true AS digest_ok FROM pages",
}
