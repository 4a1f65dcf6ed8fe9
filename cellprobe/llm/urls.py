"""URL filters: pattern rules fetched by their rarest literal token.

A URL becomes ``host || path``. A rule is a pattern over that string; it is filed under the rarest (in the
URLs at hand) of the tokens, runs of ASCII letters and digits, that any URL it fits must hold whole. A URL's
tokens fetch the rules filed under them by an equality join, and only these rules' regular expressions run.
Rules without such a token are filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rules (a few hundred bytes each) the index is broadcast; beyond, it is joined by a shuffle.
BROADCAST_RULES = 20_000
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"


@dataclass(frozen=True)
class Rule:
    """``tier`` 1 rules go before tier 0; within a tier the longest wins, then block, then the text."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    tier: int


def _quoted(text: str) -> str:
    """``text`` as a Java regular expression that matches only itself."""
    return re.sub(r"([^A-Za-z0-9/_ -])", r"\\\1", text)


def host_rule(verdict: str, text: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains, if the URL's path starts with the path."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = re.findall("[A-Za-z0-9]+", host)
    in_path = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    regex = rf"^(?:[^/]*\.)?{_quoted(host)}" + (_quoted(path) if path else r"(?=/|\z)")
    return Rule(text, verdict, regex, tuple(dict.fromkeys(whole + in_path)), 1)


def pattern_rule(verdict: str, text: str) -> Rule:
    """A rule with ``||`` (start of a host label), ``|`` (start or end), ``*`` (anything) and ``^`` (a separator or the end)."""
    body, start, end = text, "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], r"\z"
    regex = start + "".join({"*": ".*", "^": _SEPARATOR}.get(c) or _quoted(c) for c in body) + end
    framed = ("." if start else "*") + body + ("." if end else "*")
    tokens = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", framed)
    return Rule(text, verdict, f"(?s){regex}", tuple(dict.fromkeys(tokens)), 0)


# --- Fixed values: the rules of the contract, and the method's own ------------------------------------
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PATTERN_RULES = (
    ("block", "||spam-farm."),
    ("block", "||cheap-pills."),
    ("block", "||free-casino."),
    ("block", "||adserver."),
    ("block", "/ads/"),
    ("block", "/banner/*.gif|"),
    ("block", "/tracking^"),
    ("block", "/wp-login.php|"),
)
# ------------------------------------------------------------------------------------------------------


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]


def _parsed(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path; both are empty for null or for a text without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", host).withColumn("path", path)


def judge(urls: DataFrame, rules: Iterable[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row of ``urls``.

    ``rule`` is the host rule that decides, else null; ``pattern`` the pattern rule that decides where no host
    rule fits, else null; without either, ``default`` is the verdict. Null and malformed URLs have empty host and
    path and get the default. Repeated rows and null ids stay; an empty table gives no rows; other columns of
    ``urls`` are not read. One shuffle, of a row a URL, on a key that no two rows share.
    """
    spark = urls.sparkSession
    rules = list(default_rules() if rules is None else rules)
    # The number of a rule is its precedence.
    rules.sort(key=lambda r: (r.tier, len(r.text), r.verdict == "block", r.text))
    rows = _parsed(urls.select(id_col, url_col), url_col).select(F.monotonically_increasing_id().alias("_row"), id_col, "host", "path")
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.split(target, "[^A-Za-z0-9]+"), F.array(F.lit(""))))
    spread = rows.select("*", F.explode(tokens).alias("_token"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df

    listed = [(n, r.text, r.verdict, r.regex, list(r.tokens) or [""], r.tier) for n, r in enumerate(rules)]
    table = spark.createDataFrame(listed, "_number int, _text string, _verdict string, _regex string, _tokens array<string>, _tier int")
    ruled = table.select("_number", F.explode("_tokens").alias("_token"))
    seen = spread.join(small(ruled.select("_token").distinct()), "_token").groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    # Rarest first; a token that no URL has is the rarest of all.
    filed = ruled.join(seen, "_token", "left").groupBy("_number").agg(F.min_by("_token", F.struct(F.coalesce("_n", F.lit(0)), "_token")).alias("_token"))
    index = filed.join(table.select("_number", "_regex"), "_number")
    fetched = spread.join(small(index), "_token", "left")
    fits = F.expr("concat(host, path) rlike _regex")
    best = fetched.groupBy("_row", id_col, "host", "path").agg(F.max(F.when(fits, F.col("_number"))).alias("_number"))
    named = best.join(small(table.select("_number", "_text", "_verdict", "_tier")), "_number", "left")
    return named.select(id_col, "host", "path", F.when(F.col("_tier") == 1, F.col("_text")).alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"), F.when(F.col("_tier") == 0, F.col("_text")).alias("pattern"))


#: The same for the ``pages`` table in DuckDB.
ORACLE = r"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), rules(rule, verdict, rhost, rpath) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
), best AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM fits GROUP BY page_id, host, path
), patterns AS (
  SELECT *, host || path AS target FROM best
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN hit IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS pattern
FROM (SELECT *, CASE
         WHEN regexp_matches(target, '/wp-login\.php$') THEN '/wp-login.php|'
         WHEN regexp_matches(target, '/banner/.*\.gif$') THEN '/banner/*.gif|'
         WHEN regexp_matches(target, '^([^/]*\.)?free-casino\.') THEN '||free-casino.'
         WHEN regexp_matches(target, '^([^/]*\.)?cheap-pills\.') THEN '||cheap-pills.'
         WHEN regexp_matches(target, '^([^/]*\.)?spam-farm\.') THEN '||spam-farm.'
         WHEN regexp_matches(target, '^([^/]*\.)?adserver\.') THEN '||adserver.'
         WHEN regexp_matches(target, '/tracking([^A-Za-z0-9_.%-]|$)') THEN '/tracking^'
         WHEN regexp_matches(target, '/ads/') THEN '/ads/' END AS hit
      FROM patterns)
"""
