"""Boolean search expressions.

    expression := term { OR term }
    term       := factor { (AND | NOT | nothing) factor }
    factor     := '(' expression ')' | word

NOT is a difference of two sides and binds like AND; words side by side are joined by
AND. A word stands for its first run of ASCII letters and digits; one without any
matches nothing. Quoted words are so many words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import first_ascii_token

MAX_DEPTH = 50
OPERATORS = ("AND", "OR", "NOT")


class QueryError(ValueError):
    """A text that is no boolean expression."""


class Query:
    """Node of an expression."""

    def column(self, has: Callable[[str], Column]) -> Column:
        """The condition, where has(word) is the condition that a document holds the word."""
        raise NotImplementedError

    def documents(self, postings: DataFrame) -> DataFrame:
        """doc_id of the documents that match, by joins over postings (term, doc_id)."""
        raise NotImplementedError

    def words(self) -> list[str]:
        """Distinct words in order."""
        raise NotImplementedError


@dataclass(frozen=True)
class Word(Query):
    word: str

    def column(self, has):
        return has(self.word) if self.word else F.lit(False)

    def documents(self, postings):
        return postings.where(F.col("term") == self.word).select("doc_id").distinct()

    def words(self):
        return [self.word] if self.word else []


@dataclass(frozen=True)
class _Pair(Query):
    left: Query
    right: Query

    def words(self):
        return list(dict.fromkeys(self.left.words() + self.right.words()))


class And(_Pair):
    def column(self, has):
        return self.left.column(has) & self.right.column(has)

    def documents(self, postings):
        return self.left.documents(postings).join(self.right.documents(postings), "doc_id", "left_semi")


class Or(_Pair):
    def column(self, has):
        return self.left.column(has) | self.right.column(has)

    def documents(self, postings):
        return self.left.documents(postings).union(self.right.documents(postings)).distinct()


class Not(_Pair):
    """The left side without the right."""

    def column(self, has):
        return self.left.column(has) & ~self.right.column(has)

    def documents(self, postings):
        return self.left.documents(postings).join(self.right.documents(postings), "doc_id", "left_anti")


class _Reader:
    def __init__(self, text: str, any_case: bool):
        text = text.replace('"', " ")
        self.tokens = re.findall(r"[()]|[^\s()]+", text)
        if any_case:
            self.tokens = [t.upper() if t.upper() in OPERATORS else t for t in self.tokens]
        self.at, self.depth = 0, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def nested(self, rule: Callable[[], Query]) -> Query:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("query exceeded max nesting")
        try:
            return rule()
        finally:
            self.depth -= 1

    def expression(self) -> Query:
        left = self.nested(self.term)
        while self.peek() == "OR":
            self.take()
            left = Or(left, self.nested(self.term))
        return left

    def term(self) -> Query:
        left = self.nested(self.factor)
        while self.peek() not in ("", ")", "OR"):
            operator = self.take() if self.peek() in ("AND", "NOT") else "AND"
            left = (Not if operator == "NOT" else And)(left, self.nested(self.factor))
        return left

    def factor(self) -> Query:
        token = self.peek()
        if token == "(":
            self.take()
            inner = self.nested(self.expression)
            if self.take() != ")":
                raise QueryError("missing closing parenthesis")
            return inner
        if token in ("", ")", *OPERATORS):
            raise QueryError(f"unexpected token: {token}")
        self.take()
        return Word(first_ascii_token(token))


def parse(text: str, any_case: bool = False) -> Query:
    """any_case: `and`, `or`, `not` in lower case are operators too."""
    reader = _Reader(text, any_case)
    query = reader.nested(reader.expression)
    if reader.peek():
        raise QueryError(f"unexpected token: {reader.peek()}")
    return query
