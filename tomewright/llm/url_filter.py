"""URL filters: host-suffix and path-prefix expressions, matched by hash prefixes.

A URL is brought to a plain form (lower-case host, no scheme, user, port or
fragment) and expanded into every host suffix of two labels or more, combined with
its exact path and query, its path, and every directory above it. The expressions
meet the rules on the first 4 bytes of their SHA-256 (an equi-join that moves few
bytes); full digests are then compared. Of the rules that match, the longest host
wins, then the longest path, then `allow` over `block`, then the lower rule_id, then
the first category in order. A pattern without a slash is a host: it stands for all its pages.

Expansion stops at the greatest host and path depth that any rule has, which
can't lose a match. Each distinct URL is expanded once.

Defined results: a null or empty URL, or one without a host, matches nothing and
gets action `none`; a host that is an IPv4 address has no suffixes but itself;
rules with a null or empty pattern, one that begins with a slash, or an action other
than allow and block are ignored; a null rule_id comes last; rules that repeat a
rule_id count each; without rules, or pages, every page (or none) gets `none`; a very
long URL is expanded as deep as the rules go;
repeated rows get the same decision each; other columns of the rows stay out of the
result; a null page_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rule_id, pattern (host + path), action, category
DEFAULT_RULES = [
    (1, "ads-track.example.com/", "block", "ads"),
    (2, "ads-track.example.com/en/", "allow", "reviewed"),
    (3, "m.ads-track.example.com/en/", "block", "ads"),
    (4, "example.org/en/", "block", "mirror"),
    (5, "m.theren.example.org/en/", "allow", "reviewed"),
    (6, "tiontion.example.net/", "block", "spam"),
    (7, "tiontion.example.net/", "allow", "partner"),
    (8, "example.net/fr/", "block", "region"),
    (9, "ththnt.example.org/", "block", "spam"),
    (10, "tionsh.example.com/de/", "block", "spam"),
    (11, "blog.tionsh.example.com/de/2673.html", "allow", "reviewed"),
    (12, "theron.example.net/en/803/", "block", "page"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "rule_id long, pattern string, action string, category string")


def plain_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with `?`, or empty) of a URL; the host is null if there is none."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"^\.+|\.+$", ""))
    tail = F.length(authority) + 1
    after = F.substring(rest, tail, F.length(rest))
    query = F.regexp_extract(after, r"(?s)(\?.*)$", 1)
    path = F.regexp_replace(after, r"(?s)\?.*$", "")
    return F.when(host != "", host), F.when(path == "", "/").otherwise(path), query


def expand(urls: DataFrame, host_depth: int, path_depth: int) -> DataFrame:
    """url, host_length, path_length, expression of every expression that a rule of these depths can equal."""
    host, path, query = plain_url(F.col("url"))
    base = urls.select("url", host.alias("host"), path.alias("path"), query.alias("query")).where("host IS NOT NULL")
    base = base.withColumns({"labels": F.split("host", r"\."), "dirs": F.split("path", "/"), "is_ip": F.col("host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")})
    n, d = F.size("labels"), F.size("dirs")
    hosts = F.when(F.col("is_ip") | (n < 2), F.array("host")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(n, F.lit(host_depth)))), lambda k: F.array_join(F.slice(F.col("labels"), n - k + 1, k), ".")))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(d - 1, F.lit(path_depth)))), lambda k: F.concat(F.array_join(F.slice(F.col("dirs"), F.lit(1), k), "/"), F.lit("/")))
    exact = F.array_distinct(F.array(F.col("path"), F.concat("path", "query")))
    out = base.select("url", F.explode(hosts).alias("suffix"), F.array_distinct(F.concat(folders, exact)).alias("paths"))
    out = out.select("url", "suffix", F.explode("paths").alias("prefix"))
    return out.select("url", F.length("suffix").alias("host_length"), F.length("prefix").alias("path_length"), F.concat("suffix", "prefix").alias("expression"))


def decide(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, action, rule_id, category: one row a page."""
    named = rules.withColumn("pattern", F.when(F.instr("pattern", "/") == 0, F.concat("pattern", F.lit("/"))).otherwise(F.col("pattern")))
    usable = named.where("pattern IS NOT NULL AND instr(pattern, '/') > 1 AND action IN ('allow', 'block')").select("rule_id", F.lower(F.substring_index("pattern", "/", 1)).alias("h"), F.expr("substring(pattern, instr(pattern, '/'))").alias("p"), "action", "category")
    usable = usable.withColumn("digest", F.sha2(F.concat("h", "p"), 256))
    depth = usable.agg(F.max(F.size(F.split("h", r"\."))).alias("h"), F.max(F.size(F.split("p", "/")) - 1).alias("p")).first()
    listed = usable.select(F.substring("digest", 1, 8).alias("key"), "digest", "rule_id", "action", "category")
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    tried = expand(urls, depth["h"] or 2, depth["p"] or 1).withColumn("own", F.sha2("expression", 256)).withColumn("key", F.substring("own", 1, 8))
    matched = tried.drop("expression").join(listed, "key").where("own = digest")
    order = F.struct(-F.col("host_length"), -F.col("path_length"), F.col("action"), F.col("rule_id").isNull(), F.col("rule_id"), F.coalesce("category", F.lit("")))
    best = matched.groupBy("url").agg(F.min_by(F.struct("action", "rule_id", "category"), order).alias("won"))
    out = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").join(best, "url", "left")
    return out.select("page_id", "url", F.coalesce("won.action", F.lit("none")).alias("action"), F.col("won.rule_id").alias("rule_id"), F.col("won.category").alias("category"))


def oracle(rules: list[tuple] = DEFAULT_RULES) -> str:
    """The same decisions as DuckDB SQL over the view pages."""
    values = ", ".join(f"({i}, '{p}', '{a}', '{c}')" for i, p, a, c in rules)
    return f"""
WITH rules(rule_id, pattern, action, category) AS (VALUES {values}),
u AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages WHERE url IS NOT NULL),
a AS (SELECT url, rest, regexp_extract(rest, '^([^/?]*)', 1) AS authority FROM u),
b AS (SELECT url, lower(regexp_replace(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', ''), '^\\.+|\\.+$', '', 'g')) AS host, substr(rest, length(authority) + 1) AS tail FROM a),
c AS (SELECT url, host, CASE WHEN regexp_replace(tail, '\\?.*$', '', 's') = '' THEN '/' ELSE regexp_replace(tail, '\\?.*$', '', 's') END AS path, regexp_extract(tail, '(\\?.*)$', 1, 's') AS query FROM b WHERE host <> ''),
h AS (SELECT url, path, query, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') OR len(string_split(host, '.')) < 2 THEN [host]
      ELSE list_transform(range(2, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[-k:], '.')) END AS hosts FROM c),
s AS (SELECT url, path, query, unnest(hosts) AS suffix FROM h),
p AS (SELECT url, suffix, unnest(list_distinct(list_concat([path, path || query], list_transform(range(1, greatest(2, len(string_split(path, '/')))), lambda k: array_to_string(string_split(path, '/')[1:k], '/') || '/')))) AS prefix FROM s),
m AS (SELECT p.url, r.rule_id, r.action, r.category, row_number() OVER (PARTITION BY p.url ORDER BY length(suffix) DESC, length(prefix) DESC, r.action, r.rule_id) AS rn
      FROM p JOIN rules r ON r.pattern = suffix || prefix)
SELECT pages.page_id, pages.url, coalesce(m.action, 'none') AS action, CAST(m.rule_id AS BIGINT) AS rule_id, m.category
FROM pages LEFT JOIN m ON m.url = pages.url AND m.rn = 1"""
