"""Running sums and gaps over long orders, without one task that sorts a whole key.

The order is cut into parts by a column that never falls along it. Sums and gaps are
taken within (keys, part); what a part adds to the next ones comes from one row a part.
Rows are shuffled once, on (keys, part): both steps use the same exchange (the joins are
left joins as an inner one would filter nulls on one side only, and so part the two).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(rows: DataFrame, keys: list[str], part: Column) -> DataFrame:
    return rows.withColumn("_part", part).repartition(*keys, "_part")


def running_sums(rows: DataFrame, order: str, part: Column, keys: list[str], **sums: str) -> DataFrame:
    """Adds, for every name=column, the sum of the column up to and with each row, in the order of `order` within keys."""
    cut = _cut(rows, keys, part)
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    bases = totals.select(*keys, "_part", *[(F.sum(f"_{n}").over(outer) - F.col(f"_{n}")).alias(f"_{n}") for n in sums])
    return cut.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(bases, [*keys, "_part"], "left").withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def previous(rows: DataFrame, column: str, part: Column, keys: list[str], name: str) -> DataFrame:
    """Adds the value of `column` in the row before, in its own ascending order within keys; null in the first row."""
    cut = _cut(rows, keys, part)
    inner = Window.partitionBy(*keys, "_part").orderBy(column)
    outer = Window.partitionBy(*keys).orderBy("_part")
    ends = cut.groupBy(*keys, "_part").agg(F.max(column).alias("_last"))
    bases = ends.select(*keys, "_part", F.lag("_last").over(outer).alias("_before"))
    return cut.withColumn(name, F.lag(column).over(inner)).join(bases, [*keys, "_part"], "left").withColumn(name, F.coalesce(name, "_before")).drop("_part", "_before")
