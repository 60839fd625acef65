"""URL verdicts: pattern rules found by their rarest literal token.

Host/path rules and regular-expression rules share one index: each rule lies under that one of its
literal tokens that the fewest urls hold, or, without any, under the empty token that every url has.
A url's tokens fetch the rules under them; only those are tested, host/path rules by their text,
pattern rules by their regular expression. An index of up to PLAN_RULES rules is a literal map in
the plan: no join and no shuffle of urls, and one host with a third of the pages costs no more than
any other. A larger one is a table that distinct urls are joined with, token by token, with the same
result. Built-in functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.common import letters_lower

PLAN_RULES = 2_000  # a larger index does not belong in a plan and is joined as a table
RULE = "struct<kind:string,number:int,verdict:string,host:string,path:string,pattern:string>"


@dataclass(frozen=True)
class HostRule:
    """Fits the host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url. Any match of it holds all of `literals`."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]


#: The host rules of the contract.
HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)
#: Default pattern rules for urls without a host rule.
PATTERN_RULES = (
    PatternRule("block", r"[?&]utm_source=ads?(?:[&#]|$)", ("utm", "source")),
    PatternRule("block", r"://(?:[^/?#]*[.])?adserver[.]", ("adserver",)),
    PatternRule("block", r"/login(?:[/?#.]|$)", ("login",)),
    PatternRule("block", r"[.]exe(?:[?#]|$)", ("exe",)),
)


def tokens(column: Column) -> Column:
    """Distinct runs of a-z and 0-9 of a lower-cased url, and the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(F.split(column, "[^a-z0-9]+"), F.array().cast("array<string>"))))


def whole_tokens(rule: HostRule) -> list[str]:
    """Tokens that every url which the rule fits holds whole: those of the host, and of the path all
    but a last one that may go on."""
    path = re.findall("[a-z0-9]+", rule.path.lower())
    if path and re.search("[a-z0-9]$", rule.path.lower()):
        path = path[:-1]
    return re.findall("[a-z0-9]+", rule.host.lower()) + path


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: as many rows as tokens, not urls."""
    if not wanted:
        return {}
    held = F.array_intersect(tokens(letters_lower(F.col("url"))), F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def split_host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = letters_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    given = url.isNotNull() & (at > 0)
    return F.when(given, host).otherwise(F.lit("")), F.when(given, path).otherwise(F.lit(""))


def fits(url: Column, host: Column, path: Column, rule: Column) -> Column:
    """CASE keeps the regular expression from running on any but pattern candidates."""
    suffix = (host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))
    return F.when(rule["kind"] == "host", suffix & F.startswith(path, rule["path"])).otherwise(F.regexp_like(url, rule["pattern"]))


def strength(rule: Column) -> Column:
    """The greatest of the fitting rules decides."""
    return F.struct((rule["kind"] == "host").alias("first"), F.length(rule["host"]) + F.length(rule["path"]), F.length(rule["host"]), -rule["number"], rule.alias("rule"))


def by_map(parts: DataFrame, rules: list[tuple], counts: dict[str, int]) -> DataFrame:
    """parts with the deciding rule as `_best`, the index being a literal map."""
    index: dict[str, list] = {}
    for rule in rules:
        index.setdefault(min(rule[6] or [""], key=lambda t: (counts.get(t, 0), t)), []).append(rule)

    def literal(rule: tuple) -> Column:
        return F.struct(*[F.lit(v) for v in rule[:6]]).cast(RULE)

    entries = [x for token, found in sorted(index.items()) for x in (F.lit(token), F.array(*[literal(r) for r in found]))]
    table = F.create_map(*entries) if entries else F.create_map().cast(f"map<string,array<{RULE}>>")
    fetched = F.flatten(F.filter(F.transform(tokens(F.col("_url")), lambda t: F.try_element_at(table, t)), lambda found: found.isNotNull()))
    fitting = F.filter(fetched, lambda r: fits(F.col("_url"), F.col("host"), F.col("path"), r))
    # Two steps, so that the candidates are found once.
    return parts.withColumn("_fit", fitting).withColumn("_best", F.array_max(F.transform("_fit", strength))["rule"])


def by_join(parts: DataFrame, rules: list[tuple]) -> DataFrame:
    """The same by joins, for any number of rules: distinct urls meet the index token by token, and
    the deciding rule of each comes back to its rows. Common tokens are split by skew joins."""
    spark = parts.sparkSession
    schema = "kind string, number int, verdict string, host string, path string, pattern string, literals array<string>"
    table = spark.createDataFrame(rules, schema).select(F.struct("kind", "number", "verdict", "host", "path", "pattern").alias("rule"), "literals")
    urls = parts.filter("_url is not null").select("_url", "host", "path").distinct().withColumn("token", F.explode(tokens(F.col("_url"))))
    listed = table.select("rule", F.explode(F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))).alias("token"))
    counts = urls.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"]
    index = listed.join(counts, "token", "left").groupBy("rule").agg(rarest.alias("token"))
    met = urls.join(index, "token").filter(fits(F.col("_url"), F.col("host"), F.col("path"), F.col("rule")))
    best = met.groupBy("_url").agg(F.max(strength(F.col("rule")))["rule"].alias("_best"))
    return parts.join(best, "_url", "left")


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of pages.

    The longest fitting host rule decides (the host's length breaks ties); else the first matching
    pattern rule; else the url is allowed. A null url, or one without "://", has an empty host and
    path; no host rule fits it and, when null, no pattern either. A path is empty unless it starts
    at the first "/" behind the host. A rule without literal tokens is tested on every url.
    """
    rules = [("host", k, r.verdict, r.host, r.path, "", whole_tokens(r)) for k, r in enumerate(host_rules)]
    rules += [("pattern", k, r.verdict, "", "", r.pattern, [t.lower() for t in r.literals]) for k, r in enumerate(pattern_rules)]
    host, path = split_host_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = urls.select("page_id", host.alias("host"), path.alias("path"), letters_lower(F.col("url")).alias("_url"))
    if len(rules) > PLAN_RULES:
        chosen = by_join(parts, rules)
    else:
        chosen = by_map(parts, rules, token_counts(urls, sorted({t for r in rules for t in r[6]})))
    return chosen.select("page_id", "host", "path", F.when(F.col("_best.kind") == "host", F.concat("_best.host", "_best.path")).alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))
