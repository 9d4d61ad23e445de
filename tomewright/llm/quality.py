"""Quality rules: weak supervision in place of a filter that every rule must pass.

Each rule votes for a document (1), against it (-1) or abstains (0), all in Spark's
own expressions. Expectation-maximisation over the counts of the vote patterns
(every document counts; there are at most 3**rules patterns, whatever the corpus)
estimates how each rule votes on good and on bad documents. A document's posterior
probability of being good then decides.

Defined results: null or empty text has every rule abstain except the length rule,
which votes against it; ties in the posterior can't occur, as equal patterns have
equal posteriors, and a posterior equal to the threshold keeps; an empty table
gives an empty result; repeated rows count and are kept each; a very long text is read
whole; a null language or doc_id is allowed; other columns, whatever their names, stay
out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize


@dataclass(frozen=True)
class QualityParams:
    threshold: float = 0.5
    prior: float = 0.8
    #: Share of votes against, on good and on bad documents, that a rule is believed to have; it also says which class is which.
    against_good: float = 0.02
    against_bad: float = 0.5
    #: Weight of that belief, in parts of the documents on which a rule votes. It doesn't fade as the corpus grows: documents
    #: are bad in several ways, and without it the model gives its one bad class to the most frequent of them.
    belief: float = 0.2
    rounds: int = 200
    tolerance: float = 1e-9


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def features(text: Column) -> Column:
    """Counts of a text as one struct, in which it is split once into words and once into lines. Nothing is done word by word
    outside of Spark's own functions."""
    t = F.coalesce(text, F.lit(""))
    gone = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    filled = lambda t, parts: F.size(parts) - t.rlike(r"^\s").cast("int") - F.when(F.length(t) == 0, 1).otherwise(t.rlike(r"\s\z").cast("int"))
    #: ends of words that end in an odd character or in !!
    marks = r"(?:[^\p{L}\p{N}.,;:!?'\"()\-\s]|!!)(?=\s|\z)"

    def counted(t: Column, lines: Column, spaced: Column) -> Column:
        return F.struct(
            F.length(t).alias("size"),
            filled(t, F.split(t, r"\s+")).alias("words"),
            F.regexp_count(t, F.lit(marks)).alias("marked"),
            (F.size(F.array_distinct(spaced)) - F.array_contains(spaced, "").cast("int")).alias("different_words"),
            F.size(lines).alias("lines"),
            F.size(F.array_distinct(lines)).alias("different_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.!?]$"))).alias("ended"),
            gone(t, "#$%&*!|<>{}\\^~").alias("symbols"),
            gone(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
            gone(t, "|\t").alias("bars"),
        )

    # a lambda's variable is computed once, however often its body names it
    parts = F.struct(t.alias("t"), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("lines"), F.split(t, " ").alias("spaced"))
    return F.get(F.transform(F.array(parts), lambda x: counted(x["t"], x["lines"], x["spaced"])), 0)


def rules(counts: Column) -> dict[str, Column]:
    """Votes by name, from the counts of a text. A rule abstains where it has nothing to go by."""
    size, words, n_lines = counts["size"], counts["words"], counts["lines"]
    filled, few = size > 0, words < 8
    return {
        "length": _vote(words >= 20, words < 1),
        "symbols": _vote(filled & (counts["symbols"] * 200 <= size), filled & (counts["symbols"] * 33 > size)),
        "marked_words": _vote(~few & (counts["marked"] * 20 <= words), ~few & (counts["marked"] * 4 > words)),
        "word_length": _vote(~few & (size.between(words * 4, words * 9)), filled & ~few & ((size > words * 13) | (size < words * 3))),
        "upper_case": _vote(filled & (counts["upper"] * 12 <= size), filled & (counts["upper"] * 4 > size)),
        "line_ends": _vote(filled & (counts["ended"] * 2 > n_lines) & ~few, filled & (counts["ended"] * 4 < n_lines) & ~few),
        "repeated_lines": _vote((n_lines >= 4) & (counts["different_lines"] * 20 >= n_lines * 19), (n_lines >= 4) & (counts["different_lines"] * 10 < n_lines * 7)),
        "repeated_words": _vote((words >= 30) & (counts["different_words"] * 5 > words), (words >= 30) & (counts["different_words"] * 10 < words)),
        "separators": _vote(filled & (counts["bars"] * 50 < words), filled & ~few & (counts["bars"] * 4 > words)),
    }


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and the pattern of votes, one character a rule: + for, - against, 0 abstains."""
    sign = lambda v: F.when(v > 0, "+").when(v < 0, "-").otherwise("0")
    pattern = F.get(F.transform(F.array(features(F.col("text"))), lambda c: F.concat(*[sign(v) for v in rules(c).values()])), 0)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), pattern.alias("votes"))


def estimate(patterns: list[str], counts: list[int], p: QualityParams) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, P(against | class, the rule votes) as [class, rule], and the share of good documents.

    A rule that abstains says nothing. The steps maximise the posterior under the belief of `p`, so the objective never falls."""
    if not patterns:
        return np.empty(0), np.empty((2, 0)), p.prior
    v = np.array([["-0+".index(c) - 1 for c in x] for x in patterns])
    n = np.array(counts, float)
    against, favour = (v < 0).astype(float), (v > 0).astype(float)
    believed = np.array([[p.against_bad], [p.against_good]])
    strength = p.belief * (n @ (against + favour)) + 1.0
    table, prior, last = np.repeat(believed, v.shape[1], 1), p.prior, -np.inf
    for _ in range(p.rounds):
        joint = against @ np.log(table).T + favour @ np.log1p(-table).T + np.log([1 - prior, prior])
        top = joint.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        q = np.exp(joint - total[:, None])
        goal = float((n * total).sum() + (strength * (believed * np.log(table) + (1 - believed) * np.log1p(-table))).sum()) / n.sum()
        if goal - last < p.tolerance:
            break
        last = goal
        mass = lambda x: np.einsum("p,pc,pr->cr", n, q, x)
        no, yes = mass(against), mass(favour)
        table = np.clip((no + strength * believed) / (no + yes + strength), 1e-6, 1 - 1e-6)
        prior = float(np.clip((n * q[:, 1]).sum() / n.sum(), 0.02, 0.98))
    return q[:, 1], table, prior


def score(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, votes, p_quality of every row."""
    voted = materialize(votes(docs), "votes")
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3**rules rows
    posterior, _, _ = estimate([r["votes"] for r in found], [r["n"] for r in found], p)
    table = docs.sparkSession.createDataFrame([(r["votes"], float(q)) for r, q in zip(found, posterior, strict=True)], "votes string, p_quality double")
    return voted.join(F.broadcast(table), "votes").select("doc_id", "votes", "p_quality")


def keep(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The documents whose posterior reaches the threshold: doc_id, votes, p_quality."""
    return score(docs, p).where(F.col("p_quality") >= p.threshold)
