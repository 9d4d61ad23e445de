"""Joins of two sets of keyed rows (key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums


def merge_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_value, right_value): sort-merge inner join on equal keys."""
    a, b = left.select("key", F.col("value").alias("left_value")), right.select("key", F.col("value").alias("right_value"))
    return a.hint("merge").join(b, "key")


def merge_join_zip(left: DataFrame, right: DataFrame, part: Column | None = None) -> DataFrame:
    """Sort-merge join that moves both sides on at a match: the m and n rows of a key give min(m, n) rows, paired in the order of value.
    part: an expression that never falls along value; with it no task orders all rows of a key, and (key, place) spreads them for the join."""
    a, b = (x.select("key", "value", F.lit(1).cast("bigint").alias("one")) for x in (left, right))
    if part is None:
        place = F.row_number().over(Window.partitionBy("key").orderBy("value")).cast("bigint")
        a, b = (x.withColumn("place", place) for x in (a, b))
    else:
        a, b = (running_sums(x, "value", part, ["key"], place="one") for x in (a, b))
    a, b = a.select("key", "place", F.col("value").alias("left_value")), b.select("key", "place", F.col("value").alias("right_value"))
    return a.join(b, ["key", "place"]).select("key", "left_value", "right_value")


def equi_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Inner join on left_column = right_column; columns of the right side that clash get the prefix right_."""
    clash = set(left.columns)
    renamed = right.select(*[F.col(c).alias(f"right_{c}" if c in clash else c) for c in right.columns])
    other = f"right_{right_column}" if right_column in clash else right_column
    return left.join(renamed, left[left_column] == renamed[other])
