"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is (action, pattern), the pattern a host followed by a path prefix (``example.org/es/``). It fits that host and
its subdomains where the url's path starts with the rule's path; the longest fitting rule decides, the first listed on a
tie, and ``default`` where none fits. Every url is cut into literal tokens (host labels, whole path segments). A rule is
filed under the one of its own tokens that fewest urls hold; a url's tokens fetch the rules filed under them and only
those run their regular expression.

Null urls and urls without ``://`` have an empty host and path, so only ``default`` applies. Repeated rows and repeated
or null ids are judged row by row; an empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A list of more rules is joined as a table rather than carried as a literal map.
LITERAL_RULES = 2_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct ``h:label`` and ``p:segment`` tokens; the last path piece is left out unless a slash closes it."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    pieces = F.split(path, "/")
    closed = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.array_distinct(F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x))))


def rule_tokens(pattern: str) -> list[str]:
    host, slash, path = pattern.partition("/")
    return sorted({f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in (slash + path).split("/")[1:-1]})


def rule_regex(pattern: str) -> str:
    """Of host and path written together; a host holds no slash, so the first one starts the path. A pattern without a
    slash is a whole host."""
    end = "" if "/" in pattern else r"(?:/|\z)"
    return r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9_/])", r"\\\1", pattern) + end


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(priority, action, pattern, regex, tokens) from a list in the driver's memory."""
    rows = [{"priority": i, "action": a, "pattern": p, "regex": rule_regex(p), "tokens": rule_tokens(p)} for i, (a, p) in enumerate(rules)]
    schema = "array<struct<priority:int,action:string,pattern:string,regex:string,tokens:array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def filed_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with the rarest of its tokens, counted over all urls."""
    wanted = rules.select("priority", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    best = wanted.join(counts, "token", "left").groupBy("priority").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    return rules.join(best, "priority").select("priority", "action", "pattern", "regex", "token")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    filed = filed_rules(urls, rule_table(spark, rules))
    site = F.concat("host", "path")

    def best(fitting: Column) -> Column:
        return F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (-r["priority"]).alias("first"), r["pattern"].alias("rule"), r["action"].alias("action"))))

    if len(rules) <= literal_rules:
        by_token: dict[str, list] = {}
        for r in filed.collect():  # one row per rule of the caller's own list
            by_token.setdefault(r["token"], []).append({"priority": r["priority"], "action": r["action"], "pattern": r["pattern"], "regex": r["regex"]})
        index = F.from_json(F.lit(json.dumps(by_token)), "map<string,array<struct<priority:int,action:string,pattern:string,regex:string>>>")
        fetched = F.flatten(F.transform(F.filter("tokens", lambda t: F.map_contains_key(index, t)), lambda t: F.element_at(index, t)))
        judged = urls.withColumn("best", best(F.filter(fetched, lambda r: F.regexp_like(site, r["regex"]))))
    else:
        tried = urls.select("host", "path", F.explode("tokens").alias("token")).distinct().join(filed, "token").filter(F.regexp_like(site, F.col("regex")))
        winner = tried.groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), (-F.col("priority")).alias("first"), F.col("pattern").alias("rule"), "action")).alias("best"))
        judged = urls.join(winner, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
k AS (SELECT row_number() OVER () AS n, * FROM u),
b AS (
  SELECT k.n, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.action, length(r.rhost || r.rpath)) AS action
  FROM k JOIN r ON (k.host = r.rhost OR ends_with(k.host, '.' || r.rhost)) AND starts_with(k.path, r.rpath)
  GROUP BY k.n)
SELECT k.page_id, k.host, k.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM k LEFT JOIN b ON k.n = b.n
"""
