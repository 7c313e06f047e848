"""URL filtering by an index of pattern rules.

A rule is a host rule (``example.com/de/``: the host and its subdomains, a path prefix) or a pattern with
``*`` as wildcard, ``^`` as a separator, ``||`` as the start of a host and ``|`` as the start or end of the
address behind ``://``. ``parse_rules`` reads patterns from the lines of a filter list, exceptions
(``@@``) and comments included; what it cannot do as the list means it (options, element rules, schemes) is
refused with its line. Each rule is indexed by one of its literal tokens, the one that the fewest given
URLs contain. A URL's tokens fetch candidate rules, and only those run their regular expression.

Native: DataFrame functions only. URL tokens meet the index in a broadcast join whose condition is the
regular expression, so only hits leave it. The rule list is given by the caller as a Python list; up to
``BROADCAST_RULES`` it is broadcast, beyond that Spark joins it as any table. Hits are reduced to one row
per URL and joined back to the rows, so a URL that a third of all rows have is judged once.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule and the verdict allow;
patterns do not look at it. Repeated URLs get the same verdict, on every row. Rules without a usable
token are tried on every URL. An empty table gives an empty table; other columns pass through, and a
column named like a new one is replaced, other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.common import ascii_lower, aside, named, stored

BROADCAST_RULES = 100_000
ALLOW, BLOCK = "allow", "block"
NEW = ["host", "path", "rule", "pattern", "verdict"]


@dataclass(frozen=True)
class UrlRule:
    """``is_host`` rules come before patterns, longer ones first; among patterns allow wins."""

    text: str
    verdict: str
    is_host: bool

    @property
    def regex(self) -> str:
        """Matches ``host + path`` for host rules, the URL after ``://`` in lower case for patterns."""
        if self.is_host:
            host, _, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{_quoted(host.lower())}/{_quoted(path)}"
        start, body, end = self._anchored()
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
        return {"||": r"^(?:[^/?#]*\.)?", "|": "^", "": ""}[start] + "".join(parts.get(c) or _quoted(c) for c in body) + ("$" if end else "")

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that stand alone in every URL the rule fits."""
        if self.is_host:
            body = "." + self.text.lower()
        else:
            start, body, end = self._anchored()
            body = ("." if start else "") + body + ("." if end else "")
        return sorted({m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", body)})


    def _anchored(self) -> tuple[str, str, str]:
        """The anchor at the start, the pattern in lower case, the anchor at the end."""
        body = self.text.lower()
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(start) :]
        return start, body.removesuffix("|"), "|" if body.endswith("|") else ""


def parse_rules(lines: Iterable[str]) -> tuple[UrlRule, ...]:
    """The patterns of a filter list. Blank lines, comments (``!``) and the header (``[...]``) are left out;
    a pattern that stands twice counts once. ``ValueError`` names the first line that has no meaning here."""
    out: dict[UrlRule, None] = {}
    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith("!") or (text.startswith("[") and text.endswith("]")):
            continue
        verdict = ALLOW if text.startswith("@@") else BLOCK
        text = text.removeprefix("@@")
        refused = (
            "element rules are not about URLs" if re.search(r"#@?[?$]?#", text)
            else "options are not supported" if "$" in text
            else "patterns see what follows '://'" if "://" in text
            else "'|' stands at the start or the end" if "|" in text.removeprefix("|").removeprefix("|").removesuffix("|")
            else "the pattern is empty" if not text.strip("|*^")
            else None
        )
        if refused:
            raise ValueError(f"line {number}: {refused}: {line.strip()}")
        out[UrlRule(text, verdict, False)] = None
    return tuple(out)


def _quoted(literal: str) -> str:
    return re.sub(r"([^a-zA-Z0-9_])", r"\\\1", literal)


#: The host rules that the registered query judges by.
HOST_RULES = (
    UrlRule("net/", BLOCK, True),
    UrlRule("example.net/en/", ALLOW, True),
    UrlRule("example.com/de/", BLOCK, True),
    UrlRule("org/fr/", ALLOW, True),
)
#: Addresses that hold no articles: trackers, shops' carts, forms, galleries of adult or gambling sites.
PATTERN_RULES = parse_rules(
    """
    ||ads.*
    ||tracker.*
    /adserver/
    /banner/*.gif^
    /wp-login.php
    /cart/checkout^
    ||casino.*/play/
    ||poker.*
    ||porn.*
    ||xxx.*
    @@||help.*/cart/checkout^
    """.splitlines()
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def rule_index(spark: SparkSession, rules: tuple[UrlRule, ...], tokens: DataFrame) -> DataFrame:
    """The rules with the token to index them by; ``tokens`` has the tokens of the given URLs, one a row."""
    rows = [(i, r.text, r.regex, r.verdict, r.is_host, r.tokens or [""]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_id int, text string, regex string, rule_verdict string, is_host boolean, tokens array<string>")
    choices = table.select("rule_id", F.explode("tokens").alias("token"))
    wanted = choices.select("token").distinct()
    seen = tokens.join(_small(wanted, rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    order = F.struct(F.coalesce("seen", F.lit(0)), -F.length("token"), "token")
    rarest = choices.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", order).alias("token"))
    return table.drop("tokens").join(rarest, "rule_id")


def _small(df: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = HOST_RULES + PATTERN_RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, the ``rule`` and the ``pattern`` that decided (null if none) and
    the ``verdict``. See the module for nulls, ties and empty input."""
    spark = pages.sparkSession
    urls = pages.select(named(url).alias("_url")).where(F.instr("_url", "://") > 0).distinct()
    host_of, path_of = host_and_path(F.col("_url"))
    urls = urls.select("_url", F.concat(host_of, path_of).alias("_plain"), F.lower(after_scheme(F.col("_url"))).alias("_low"))
    each = urls.select("*", F.explode(F.array_union(F.array(F.lit("")), tokens_of(F.col("_low")))).alias("token"))
    index = stored(rule_index(spark, rules, each.select("token")), "url-rules")
    fits = F.rlike(F.when(F.col("is_host"), F.col("_plain")).otherwise(F.col("_low")), F.col("regex"))
    hits = each.join(_small(index, rules), (each["token"] == index["token"]) & fits)
    strength = F.struct("is_host", F.when(F.col("is_host"), F.length("text")), (F.col("rule_verdict") == ALLOW).alias("allow"), F.col("text").alias("text"), F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("_url").agg(F.max(strength).alias("best"))
    taken = {c.lower() for c in NEW}
    own = [c for c in pages.columns if c.lower() not in taken]
    away, back = aside(own)
    rows = pages.select(*away, named(url).alias("_of"))
    host, path = host_and_path(F.col("_of"))
    out = rows.join(best, F.col("_of") == F.col("_url"), "left")
    return out.select(
        *back,
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.is_host"), F.col("best.text")).alias("rule"),
        F.when(~F.col("best.is_host"), F.col("best.text")).alias("pattern"),
        F.coalesce(F.col("best.verdict"), F.lit(ALLOW)).alias("verdict"),
    )
