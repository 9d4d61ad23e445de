"""BM25 as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25(tf: Column, doc_length: Column, mean_length: Column, documents: Column, document_frequency: Column, k1: float = K1, b: float = B) -> Column:
    """Score of one term in one document. No term or no documents score 0; a frequency or a length of 0 or less counts as 1."""
    n, df = documents.cast("double"), F.greatest(document_frequency.cast("double"), F.lit(1.0))
    at_least_one = lambda c: F.when(c > 0, c.cast("double")).otherwise(F.lit(1.0))
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    norm = (1 - b) + b * at_least_one(doc_length) / at_least_one(mean_length)
    t = tf.cast("double")
    return F.when((t <= 0) | (n <= 0), F.lit(0.0)).otherwise(idf * t * (k1 + 1) / (t + k1 * norm))
