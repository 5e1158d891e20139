"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host and a path prefix and says ``block`` or ``allow``.  Each
rule becomes one regular expression and is filed under one of its literal
tokens: the one that the fewest URLs hold.  A URL is cut into tokens, the
tokens fetch the rules filed under them, and only those rules run their
expression.  A rule without a usable literal token is tried on every URL.

Built-in functions only; no Python code runs on the executors.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules travel inside the plan; more are joined by token.
INLINE_RULES = 256
#: A rule index of up to so many rows is broadcast; a larger one is shuffled.
BROADCAST_RULES = 50_000
#: Rule that is filed under no token.
ANY_TOKEN = ""

_SEPARATORS = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host with its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str = ""

    def __post_init__(self) -> None:
        if self.verdict not in ("block", "allow"):
            raise ValueError(f"verdict must be block or allow, not {self.verdict!r}")
        if self.path and not self.path.startswith("/"):
            raise ValueError("the path of a rule starts with a slash")

    @classmethod
    def parse(cls, verdict: str, rule: str) -> UrlRule:
        host, slash, path = rule.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Java expression over host and path written together; the host holds no slash."""
        return r"^(?:[^/]*\.)?" + _quoted(self.host) + (_quoted(self.path) if self.path else r"(?=/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds as whole tokens."""
        found = re.split(_SEPARATORS, self.text)
        if self.path and re.search("[0-9A-Za-z]$", self.path):
            found.pop()  # the URL may go on ("/7" fits "/70"), so the end of a path is no whole token
        return sorted({t for t in found if t})


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _quoted(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z_/-])", r"\\\1", literal)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.concat(host, path), _SEPARATORS), lambda t: t != ""))


def index_rules(urls: DataFrame, rules: Sequence[UrlRule], tokens: Column) -> dict[str, list[UrlRule]]:
    """Rules by their rarest literal token over all rows of ``urls``; ties go to the smaller token.

    One aggregation counts the URLs with each literal of a rule; at most one row per literal comes back.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if literals:
        held = F.array_intersect(tokens, F.split(F.lit(" ".join(literals)), " "))
        counts = {r["token"]: r["n"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[UrlRule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=ANY_TOKEN)
        index.setdefault(token, []).append(rule)
    return index


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict, n_tried`` - one row per input row.

    Of all fitting rules the longest decides (ties: ``block`` before ``allow``, then the smaller text);
    ``rule`` is null and the verdict is ``default`` if none fits.  ``n_tried`` counts the expressions that ran.

    A null URL or one without ``://`` has empty host and path, so no rule with a host fits.  Repeated rows
    are judged each, extra columns of ``pages`` are ignored, an empty table or rule list gives no rules.
    """
    if len({(r.text, r.verdict) for r in rules}) != len(rules):
        raise ValueError("a rule is given twice")
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    index = index_rules(urls, rules, url_tokens(F.col("host"), F.col("path")))
    judge = _judge_inline if len(rules) <= inline_rules else _judge_joined
    judged = judge(urls, index)
    best = F.col("best")
    return judged.select(
        "page_id", "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"), F.coalesce("n_tried", F.lit(0)).cast("int").alias("n_tried"),
    )


def _rows(index: dict[str, list[UrlRule]]) -> list[tuple]:
    """token, rank (larger wins), rule, verdict, pattern."""
    order = sorted((r for rules in index.values() for r in rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    rank = {r: len(order) - i for i, r in enumerate(order)}
    return [(token, rank[r], r.text, r.verdict, r.pattern) for token, rules in index.items() for r in rules]


def _judge_inline(urls: DataFrame, index: dict[str, list[UrlRule]]) -> DataFrame:
    """No shuffle: the small index is part of the projection."""
    filed: dict[str, list[tuple]] = {}
    for token, *rest in _rows(index):
        filed.setdefault(token, []).append(tuple(rest))

    def entry(rank: int, rule: str, verdict: str, pattern: str) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern"))

    nothing = F.filter(F.array(entry(0, "", "", "")), lambda r: r["rank"] > 0)
    tokens, whole = url_tokens(F.col("host"), F.col("path")), F.concat("host", "path")
    always = filed.pop(ANY_TOKEN, None)
    fetched = [F.array(*(entry(*r) for r in always))] if always else []
    if filed:
        # tokens that no rule is filed under are dropped by one set operation before any lookup
        known = F.array_intersect(tokens, F.split(F.lit(" ".join(sorted(filed))), " "))
        table = F.create_map(*(x for token, rows in sorted(filed.items()) for x in (F.lit(token), F.array(*(entry(*r) for r in rows)))))
        fetched.append(F.flatten(F.transform(known, lambda t: table[t])))
    urls = urls.withColumn("tried", F.concat(*fetched) if fetched else nothing)
    fitting = F.filter("tried", lambda r: F.regexp_like(whole, r["pattern"]))
    return urls.select("page_id", "host", "path", F.array_max(fitting).alias("best"), F.size("tried").alias("n_tried"))


def _judge_joined(urls: DataFrame, index: dict[str, list[UrlRule]]) -> DataFrame:
    """Many rules: distinct URLs meet the index by token, and pages meet the verdicts by URL.

    Working on distinct host and path pairs makes a URL that holds a third of all rows one row.
    """
    spark = urls.sparkSession
    rows = _rows(index)
    table = spark.createDataFrame(rows, "token string, rank int, rule string, verdict string, pattern string")
    if len(rows) <= BROADCAST_RULES:
        table = F.broadcast(table)
    keys = urls.select("host", "path").distinct()
    tokens = url_tokens(F.col("host"), F.col("path"))
    if ANY_TOKEN in index:
        tokens = F.concat(F.array(F.lit(ANY_TOKEN)), tokens)
    tried = keys.select("host", "path", F.explode(tokens).alias("token")).join(table, "token")
    fits = F.regexp_like(F.concat("host", "path"), F.col("pattern"))
    best = tried.groupBy("host", "path").agg(
        F.max(F.when(fits, F.struct("rank", "rule", "verdict"))).alias("best"), F.count(F.lit(1)).alias("n_tried")
    )
    return urls.join(best, ["host", "path"], "left")
