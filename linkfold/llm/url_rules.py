"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule names tokens that any URL it fits must hold.  The tokens' counts over all URLs give each rule's rarest one, under
which it is filed; a URL's own tokens fetch the few rules that may fit, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[A-Za-z0-9]+")
#: Rules that are broadcast at most (about 200 MB with compiled expressions); a longer list is refused, not cut.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """A rule over "host<NUL>path": ``strength`` decides between fitting rules, larger first, then the rules' order; ``shown`` is the name it goes by, if any."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    strength: int = 0
    shown: str | None = None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and all its subdomains, where the path starts with ``path``; the longest such rule wins."""
    whole = path[: path.rfind("/") + 1]  # the path's last token may go on in a URL
    pattern = rf"(?:[^\0]*\.)?{re.escape(host)}\0{re.escape(path)}"
    return Rule(verdict, pattern, tuple(_TOKEN.findall(host) + _TOKEN.findall(whole)), 1 + len(host) + len(path), host + path)


def label_rule(verdict: str, label: str) -> Rule:
    """A rule for hosts with a label (a part between dots) that holds ``label`` between hyphens or ends."""
    return Rule(verdict, rf"(?:[^\0]*[.-])?{re.escape(label)}[.-][^\0]*\0", tuple(_TOKEN.findall(label)))


#: The rules that are asked for.
HOST_RULES = (
    host_rule("block", "com", "/en/"),
    host_rule("allow", "example.com", "/en/7"),
    host_rule("allow", "net", "/de/"),
    host_rule("block", "example.net", "/de/8"),
    host_rule("block", "org", "/es/"),
)
#: Host labels of adult sites, gambling, pill shops, trackers and link farms, for URLs that no host rule fits.
BLOCKED_LABELS = (
    "adserver", "ads-track", "adult", "betting", "bets", "bingo", "blackjack", "casino", "cheap-meds", "cheap-pills", "cialis", "clickfarm", "cracked", "doorway", "escort", "escorts",
    "essay-mill", "fake-id", "free-bets", "free-robux", "gambling", "get-rich", "jackpot", "keygen", "link-farm", "linkfarm", "lottery", "malware", "nude", "nudes", "payday-loans",
    "phishing", "pill-shop", "poker", "porn", "porno", "replica-watches", "roulette", "scam", "sex", "slots", "spam", "spam-farm", "sportsbook", "torrents", "trackers", "viagra", "warez",
    "webcams", "xxx",
)
LABEL_RULES = tuple(label_rule("block", x) for x in BLOCKED_LABELS)


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (kind, verdict, host, path), in the order of its column ``place``: kind "host" or "label", the label in ``host``.

    Rows with another kind or verdict, or without a host, are refused.  A table of more than ``MAX_RULES`` rows is refused, not cut.
    """
    rows = table.select("place", "kind", "verdict", "host", "path").orderBy("place").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in rows:
        if r["kind"] not in ("host", "label") or r["verdict"] not in ("allow", "block") or not r["host"]:
            raise ValueError(f"not a rule: {r}")
        out.append(host_rule(r["verdict"], r["host"].lower(), r["path"] or "/") if r["kind"] == "host" else label_rule(r["verdict"], r["host"].lower()))
    return tuple(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path of a URL; both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


class RuleIndex:
    """Rules by their rarest token; those without a token are tried on every URL."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.filed: dict[str, list[tuple[int, int, Rule, re.Pattern]]] = {}
        self.always: list[tuple[int, int, Rule, re.Pattern]] = []
        for place, rule in enumerate(rules):
            compiled = -rule.strength, place, rule, re.compile(rule.pattern, re.DOTALL)
            if rule.tokens:
                self.filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(compiled)
            else:
                self.always.append(compiled)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The name of the strongest rule that fits, the first of equals, and its verdict; "allow" where none does."""
        subject = f"{host}\0{path}"
        fetched = [r for t in dict.fromkeys(_TOKEN.findall(subject)) for r in self.filed.get(t, ())]
        for _, _, rule, pattern in sorted(self.always + fetched, key=lambda r: r[:2]):
            if pattern.match(subject):
                return rule.shown, rule.verdict
        return None, "allow"


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs of ``pages`` (url) each of the rules' tokens occurs; as many rows as tokens reach the driver at most."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    asked = F.array(*[F.lit(t.lower()) for t in sorted(tokens)]) if tokens else F.array().cast("array<string>")
    rows = pages.select(F.explode(F.array_intersect(found, asked)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    low = {r["token"]: r["n"] for r in rows}
    return {t: low.get(t.lower(), 0) for t in tokens}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + LABEL_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict ("allow" or "block") for each row of ``pages`` (page_id, url; others are ignored).

    rule: the host rule's host and path, null where another kind or no rule decides.  A null URL, or one without "://", has an empty
    host and path, which no rule fits.  Repeated rows are judged alike.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
    counts = token_counts(pages, {t for r in rules for t in r.tokens})
    held = pages.sparkSession.sparkContext.broadcast((rules, counts))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(*held.value)
        for batch in batches:
            rows = []
            for page, url in zip(batch["page_id"], batch["url"], strict=True):
                host, path = split_url(url)
                rows.append((page, host, path, *index.judge(host, path)))
            yield pd.DataFrame(rows, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string")
