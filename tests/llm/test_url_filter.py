import pytest

from tomewright.llm import url_filter as U

RULES = "rule_id long, pattern string, action string, category string"


def brute(url, rules):
    """Decision by trying every rule on the taken-apart URL."""
    if not url:
        return None
    rest = url.split("#")[0].strip()
    rest = rest.split("://", 1)[1] if "://" in rest.split("/")[0] + "://" and "://" in rest else rest
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0] or [len(rest)])
    host, tail = rest[:cut].rsplit("@", 1)[-1].split(":")[0].lower(), rest[cut:]
    path, mark, query = tail.partition("?")
    path = path or "/"
    best = None
    for rule in rules:
        rid, pattern, action, _ = rule
        if not pattern or pattern[0] == "/" or action not in ("allow", "block"):
            continue
        pattern += "" if "/" in pattern else "/"
        h, _, p = pattern.partition("/")
        h, p = h.lower(), "/" + p
        labels = host.split(".")
        ip = len(labels) == 4 and all(x.isdigit() for x in labels)
        if not (h == host or (not ip and host.endswith("." + h) and "." in h)):
            continue
        if not (p in (path, path + mark + query) or (p.endswith("/") and path.startswith(p))):
            continue
        key = (len(h), len(p), action == "allow", rid is not None, -(rid or 0))
        if best is None or key > best[0]:
            best = key, rule
    return best and best[1]


RULE_ROWS = [
    (1, "example.com/", "block", "a"), (2, "www.example.com/", "allow", "b"), (3, "example.com/x/", "allow", "c"), (4, "example.com/x/y.html", "block", "d"), (5, "example.com/x/y.html?q=1", "allow", "e"),
    (6, "10.0.0.1/", "block", "ip"), (7, "0.0.1/", "block", "never"), (8, "Tie.org/", "block", "t"), (9, "tie.org/", "allow", "t"), (10, None, "block", "n"), (11, "tie.org/", "other", "n"), (12, "a.b.c.d.e.deep.net/1/2/3/4/5/6/7/8/", "block", "deep"),
    (13, "tie.org/", "allow", "later"), (14, "bare.example.net", "block", "host"), (14, "bare.example.net", "block", "a host"), (15, "", "block", "n"), (16, "/only/path", "block", "n"), (None, "bare.example.net", "block", "0"),
]
URLS = [
    "http://example.com", "https://EXAMPLE.com:8080/x/y.html", "https://user:pw@www.example.com/x/", "http://sub.www.example.com/q", "http://example.com/x/y.html?q=1#frag", "http://example.com/x/z?q", "http://10.0.0.1/a", "http://tie.org",
    "http://notexample.com/", "http://bare.example.net/any/page", "https://x.bare.example.net", "http://a.b.c.d.e.deep.net/1/2/3/4/5/6/7/8/9", "http://z.a.b.c.d.e.deep.net/1/2/3/4/5/6/7/", "", "http:///nohost", "localhost/x", "http://example.com?q=1", "http://example.com/" + "p/" * 3000,
]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS)] + [(None, None, None, "x", "y"), (0, URLS[0], "h", "x", "y")], "page_id long, url string, html string, action string, rule_id string")
    rows = U.decide(pages, spark.createDataFrame(RULE_ROWS, RULES)).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        rule = brute(r["url"], RULE_ROWS)
        assert (r["action"], r["rule_id"]) == ((rule[2], rule[0]) if rule else ("none", None)), r["url"][:80]
        if rule and rule[0] == 14:
            assert r["category"] == "a host"


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert U.decide(pages, spark.createDataFrame([], RULES)).first()["action"] == "none"
    assert U.decide(pages.limit(0), U.default_rules(spark)).count() == 0


@pytest.mark.parametrize("depth", [(2, 1), (6, 10)])
def test_expansion_is_limited_by_rules(spark, depth):
    urls = spark.createDataFrame([("http://a.b.c.d.example.com/1/2/3/4?q",)], "url string")
    rows = [r["expression"] for r in U.expand(urls, *depth).collect()]
    assert len(rows) == len(set(rows))
    assert "example.com/" in rows and "example.com/1/2/3/4?q" in rows
