"""URL filters: pattern rules fetched by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua.llm.texts import free_name, texts_of

# fixed values: patterns of addresses to leave out, as (part of the URL, pattern). A run of letters and digits
# is a whole token unless it stands beside a *, which means anything; other signs mean themselves
BLOCK_PATTERNS = (
    ("host", "casino"), ("host", "poker"), ("host", "free-bets"), ("host", "bets"), ("host", "cheap-pills"),
    ("host", "pills"), ("host", "viagra"), ("host", "porn"), ("host", "xxx"), ("host", "warez"), ("host", "spam"),
    ("host", "payday-loans"), ("host", "ads"), ("host", "adserver"), ("host", "doubleclick"), ("host", "phishing"),
    ("path", "wp-login.php"), ("path", "xmlrpc.php"), ("path", "clickbait"), ("path", "link-farm"),
    ("path", "affiliate*redirect"), ("path", "cgi-bin*spam"),
)
_TOKEN = re.compile(r"[a-z0-9]+")
_SCHEME = "://"

# fixed values: (host, path, verdict); a rule fits its host, all subdomains and all paths that start with its path
SITE_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = SITE_RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null fields if none does."""
    found = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def to_regex(part: str, pattern: str) -> str:
    """The regular expression of a pattern, over what follows :// in a lower-cased URL."""
    inside = "[^/?#]" if part == "host" else "."
    body = "".join(f"{inside}*" if c == "*" else re.escape(c) for c in pattern)
    before = f"(?:{inside}*)?" if not _TOKEN.match(pattern) else f"(?:{inside}*{_edge(inside)})?"
    after = "(?:[^a-z0-9]|$)" if _TOKEN.match(pattern[-1:]) else ""
    start = "^" if part == "host" else "^[^/?#]*[/?#]"
    return start + before + body + after


def _edge(inside: str) -> str:
    return "[^a-z0-9/?#]" if inside != "." else "[^a-z0-9]"


def literal_tokens(pattern: str) -> list[str]:
    """The whole tokens that every matching URL holds."""
    return [
        m[0] for m in _TOKEN.finditer(pattern)
        if not pattern[:m.start()].endswith("*") and not pattern[m.end():].startswith("*")
    ]


def token_counts(urls: DataFrame, url: str, wanted: Sequence[str]) -> dict[str, int]:
    """In how many of all URLs each wanted token stands; as many results as tokens."""
    found = urls.select(F.explode(F.array_distinct(F.array_intersect(
        F.split(F.lower(F.col(url)), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in wanted])))).alias("token"))
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


class RuleIndex:
    """Rules under their rarest token; rules without a whole literal token are tried on every URL."""

    def __init__(self, patterns: Sequence[tuple[str, str]], counts: dict[str, int]):
        self.patterns = list(patterns)
        self.compiled = [re.compile(to_regex(*p), re.S) for p in patterns]
        self.by_token: dict[str, list[int]] = {}
        self.rest: list[int] = []
        for number, (_, pattern) in enumerate(patterns):
            tokens = literal_tokens(pattern)
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(number)
            else:
                self.rest.append(number)

    def first_match(self, url: str) -> str | None:
        """The first pattern in the given order that fits; only fetched ones are run."""
        low = url.lower().partition(_SCHEME)[2]
        fetched = set(self.rest)
        for token in set(_TOKEN.findall(low)):
            fetched.update(self.by_token.get(token, ()))
        return next((":".join(self.patterns[n]) for n in sorted(fetched) if self.compiled[n].search(low)), None)


def judge(pages: DataFrame, url: str = "url", patterns: Sequence[tuple[str, str]] = BLOCK_PATTERNS,
          sites: Sequence[tuple[str, str, str]] = SITE_RULES, into: str = "judged") -> DataFrame:
    """``pages`` with a struct ``into``: host, path, rule, pattern, verdict.

    The longest site rule that fits decides; where none does, a URL is blocked
    if a pattern fits it and allowed otherwise. A null URL and one without ://
    have empty host and path, fit nothing and are allowed. Rows are judged in
    place, repeated ones too; an empty table gives an empty one. The rules are
    a parameter and travel with the job; token counts cover all rows.
    ``into`` must not be a column of ``pages``.
    """
    if into.lower() in (c.lower() for c in pages.columns):
        raise ValueError(f"{into} is a column already")
    wanted = sorted({t for _, p in patterns for t in literal_tokens(p)})
    index = (list(patterns), token_counts(pages, url, wanted) if wanted else {})

    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = RuleIndex(*index)
        for urls in batches:
            yield pa.array([rules.first_match(u) if u else None for u in texts_of(urls)], pa.string())

    name = free_name(pages, "_pattern")
    found = pages.withColumn(name, F.arrow_udf(match, "string").asNondeterministic()(F.col(url)))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    site = site_rule(host, path, sites)
    pattern = F.col(name)
    verdict = F.coalesce(site["verdict"], F.when(pattern.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.withColumn(into, F.struct(
        host.alias("host"), path.alias("path"), site["rule"].alias("rule"), pattern.alias("pattern"),
        verdict.alias("verdict"),
    )).drop(name)
