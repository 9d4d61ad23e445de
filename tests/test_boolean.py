import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tomewright.operators import index, search
from tomewright.plans.boolean import And, Not, Or, QueryError, Word, parse

DOCS = [(1, "cybersecurity research adversarial ai"), (2, "cryptography modular point transformer"), (3, "adversarial ai ethical inversion")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*DOCS, (4, None), (5, "")], "doc_id bigint, text string").cache()


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [("adversarial AND ai", [1, 3]), ("adversarial NOT research", [3]), ("cryptography OR inversion", [2, 3]), ("(research OR ethical) AND ai", [1, 3]), ("ai research", [1]), ('"Adversarial AI"', [1, 3]), ("nothing_here", []), ("threat_level OR ai", [1, 3])],
)
def test_three_ways_agree(docs, text, expected):
    posted = index.postings(docs)
    assert ids(search.matching_by_scan(docs, text)) == expected
    assert ids(search.matching_by_joins(posted, text)) == expected
    assert ids(search.matching_in_one_pass(posted, text)) == expected


@pytest.mark.parametrize(("text", "error"), [("NOT ai", "unexpected token: NOT"), ("a AND NOT b", "unexpected token: NOT"), ("(a OR b", "missing closing parenthesis"), ("", "unexpected token: "), ("a )", "unexpected token: )"), ("a OR", "unexpected token: ")])
def test_errors(text, error):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert str(e.value) == error


def test_depth_limit():
    parse("(" * 15 + "a" + ")" * 15)
    with pytest.raises(QueryError, match="query exceeded max nesting"):
        parse("(" * 16 + "a" + ")" * 16)


def test_precedence_and_case():
    assert parse("a OR b AND c") == Or(Word("a"), And(Word("b"), Word("c")))
    assert parse("a AND b NOT c") == Not(And(Word("a"), Word("b")), Word("c"))
    assert parse("a and b") == And(And(Word("a"), Word("and")), Word("b"))
    assert parse("a and b", any_case=True) == And(Word("a"), Word("b"))
    assert parse("threat_level") == Word("threat")
    assert parse("***") == Word("")


words = st.sampled_from("red blue green gold".split())
queries = st.recursive(words.map(Word), lambda q: st.one_of(*[st.builds(c, q, q) for c in (And, Or, Not)]), max_leaves=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(queries, st.lists(st.lists(words, max_size=3), min_size=1, max_size=5))
def test_against_sets(spark, query, texts):
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")

    def truth(q):
        if isinstance(q, Word):
            return {i for i, t in enumerate(texts) if q.word in t}
        a, b = truth(q.left), truth(q.right)
        return a & b if isinstance(q, And) else a | b if isinstance(q, Or) else a - b

    expected = sorted(truth(query))
    posted = index.postings(frame)
    assert ids(search.matching_by_scan(frame, query)) == expected
    assert ids(search.matching_in_one_pass(posted, query)) == expected
    assert ids(search.matching_by_joins(posted, query)) == expected
