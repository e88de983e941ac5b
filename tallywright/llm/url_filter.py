"""URL filters by pattern rules that are indexed by their rarest literal token.

Each rule is a regular expression over host + path and lists the literal tokens that any match must hold. It is filed
under the one that the fewest URLs hold, counted over all URLs. A URL's tokens fetch the rules filed under them, and
only those run their expressions, besides the rules without a literal token.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rules of a part of the rule set, each of which is sent to every task.
RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """weight: of the rules that match, the one with the largest weight decides; ties go to the smaller name."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that start with `path`. The longest such rule wins."""
    ended = path if re.search(r"[^A-Za-z0-9]\Z", path) else re.sub(r"[A-Za-z0-9]+\Z", "", path)  # its last token may go on
    return Rule(host + path, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, tuple(_TOKEN.findall(f"{host}{ended}".lower())), 1_000_000 + len(host + path))


def pattern_rule(verdict: str, name: str, pattern: str, tokens: tuple[str, ...] = ()) -> Rule:
    """A rule by a regular expression over host + path. tokens: runs of a-z and 0-9, each of which stands on its own
    (not inside a longer run) in the lower-cased form of whatever the pattern matches."""
    return Rule(name, pattern, verdict, tokens, len(pattern))


#: The method's own patterns, for URLs that no host rule fits. Fixed values.
OWN_PATTERNS = (
    pattern_rule("block", "login pages", r"(?i)/(?:account/)?login(?:/|\Z)", ("login",)),
    pattern_rule("block", "advertising servers", r"(?i)\A(?:[^/]*\.)?adserver\.", ("adserver",)),
    pattern_rule("block", "shopping carts", r"(?i)/checkout(?:/|\Z)", ("checkout",)),
)


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Both empty for a null or without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rules_of(table: DataFrame) -> Iterator[Rule]:
    """The rules of a table (verdict, host, path, name, pattern, tokens), one at a time: rows with a host are host rules
    (a null path is /), others pattern rules (null tokens: none). Rows with neither host nor pattern are no rules."""
    for r in table.select("verdict", "host", "path", "name", "pattern", "tokens").where("host is not null or pattern is not null").toLocalIterator():
        if r["host"] is not None:
            yield host_rule(r["verdict"], r["host"], r["path"] or "/")
        else:
            yield pattern_rule(r["verdict"], r["name"] or r["pattern"], r["pattern"], tuple(r["tokens"] or ()))


def _judge(base: DataFrame, rules: list[Rule]) -> F.Column:
    """The verdict (weight, rule, verdict) of one part of the rules; null where none matches."""
    spark = base.sparkSession
    wanted = spark.sparkContext.broadcast(frozenset(t for r in rules for t in r.tokens))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]+)"), 1))

    def known(batches):
        for pdf in batches:
            yield pd.DataFrame({"token": pd.Series([t for ts in pdf.ts for t in ts if t in wanted.value], dtype=object)})

    counts = base.select(tokens.alias("ts")).mapInPandas(known, "token string").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()} if wanted.value else {}  # as many rows as the rules have tokens
    filed, always = defaultdict(list), []
    for r in rules:
        (filed[min(r.tokens, key=lambda t: (seen.get(t, 0), t))] if r.tokens else always).append(r)
    index = spark.sparkContext.broadcast((dict(filed), always))

    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        filed, always = index.value
        compiled: dict[str, re.Pattern] = {}
        rows = []
        for h, p in zip(host, path, strict=True):
            url, best = h + p, None
            for r in [*always, *(r for t in set(_TOKEN.findall(url.lower())) for r in filed.get(t, ()))]:
                if (best is None or (-r.weight, r.name) < (-best.weight, best.name)) and (compiled.get(r.pattern) or compiled.setdefault(r.pattern, re.compile(r.pattern))).search(url):
                    best = r
            rows.append((best.weight, best.name, best.verdict) if best else (None, None, None))
        return pd.DataFrame(rows, columns=["weight", "rule", "verdict"]).astype({"weight": "Int64"})

    return F.pandas_udf(judge, "weight long, rule string, verdict string")("host", "path")


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Judge every URL by a rule set: rules, or a table of rules as in rules_of().

    Returns one row for each input row: page_id, host, path, rule (name of the rule that decides, or null), verdict (its
    verdict, or `default`). A null or malformed URL has empty parts and can only match rules that match an empty text; a
    very long one is judged whole. Rows that repeat are judged each; a null id stays null. Other columns are not looked at,
    whatever their names. An empty table gives no rows, an empty rule set the default. More than RULES rules are cut into
    parts; the URLs' tokens are counted once for each part, and all parts judge in one pass over the table.
    """
    host, path = url_parts(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    given = iter(rules_of(rules) if isinstance(rules, DataFrame) else rules)
    out, parts = base, 0
    while part := list(islice(given, RULES)):
        out, parts = out.withColumn(f"j{parts}", _judge(base, part)), parts + 1
    best = F.lit(None).cast("struct<weight: long, rule: string, verdict: string>")
    for k in range(parts):
        new, old = F.col(f"j{k}"), best
        better = old["rule"].isNull() | (new["weight"] > old["weight"]) | ((new["weight"] == old["weight"]) & (new["rule"] < old["rule"]))
        best = F.when(new["rule"].isNotNull() & better, new).otherwise(old)
    out = out.withColumn("j", best)
    return out.select("page_id", "host", "path", "j.rule", F.coalesce("j.verdict", F.lit(default)).alias("verdict"))
