"""robots.txt: outcomes, groups, longest match, crawl delay."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

DELAY_CAP_MS = 10000
ROBOTS_BYTES = 512000
HOPS = 5


@dataclass
class Rules:
    """The rules that hold for one product token, each (allow, pattern), and its crawl delay in seconds."""

    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None


def parse(text: str, token: str) -> Rules:
    """The token's own groups, or those for * where it has none; agents match whatever their case."""
    groups: dict[str, Rules] = {}
    agents: list[str] = []
    in_rules = False
    for line in re.split(r"\r\n|\r|\n", text.lstrip("\ufeff")):
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower().split("/")[0].strip())
            groups.setdefault(agents[-1], Rules())
        elif name in ("allow", "disallow", "crawl-delay"):
            in_rules = True
            for agent in agents:
                if name == "crawl-delay":
                    try:
                        groups[agent].delay = float(value)
                    except ValueError:
                        pass
                elif value:
                    groups[agent].rules.append((name == "allow", value))
    return groups.get(token.lower(), groups.get("*", Rules()))


def regex_of(pattern: str) -> str:
    """A rule's pattern as a regular expression for the start of path and query."""
    end = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if end else pattern))
    return f"^{body}" + ("$" if end else "")


def product_token(user_agent: str) -> str:
    """What stands before the first slash or white space."""
    return re.split(r"[/\s]", user_agent, maxsplit=1)[0]


class Matcher:
    """The rules of one file, for many paths: plain prefixes by a table of their own, patterns one by one."""

    def __init__(self, rules: list[tuple[bool, str]]):
        self.plain: dict[str, bool] = {}
        self.patterns: dict[str, tuple[re.Pattern, bool]] = {}
        for allow, p in rules:
            if "*" in p or p.endswith("$"):
                self.patterns[p] = re.compile(regex_of(p)), allow or self.patterns.get(p, (None, False))[1]
            else:
                self.plain[p] = allow or self.plain.get(p, False)
        self.lengths = sorted({len(p) for p in self.plain})
        self.longest = sorted(self.patterns, key=len, reverse=True)

    def allows(self, path: str) -> bool:
        """The longest matching rule decides; allow wins a tie; without a match the path is allowed."""
        best = (0, True)
        for n in self.lengths:
            if n > len(path):
                break
            if (allow := self.plain.get(path[:n])) is not None:
                best = max(best, (n, allow)) if n == best[0] else (n, allow)
        for p in self.longest:
            if len(p) < best[0]:
                break
            pattern, allow = self.patterns[p]
            if (len(p), allow) > best and pattern.match(path):
                best = (len(p), allow)
        return best[1]


def allowed_path(path: str, rules: list[tuple[bool, str]]) -> bool:
    return Matcher(rules).allows(path)


#: More rules than this are joined (``robots_table.decide``), as an expression with a branch for each has no end.
BRANCHES = 64


def allowed(url: Column, rules: list[tuple[bool, str]]) -> Column:
    """The same decision over URLs, for few rules, as one expression."""
    if not rules:
        return F.lit(True)
    if len(rules) > BRANCHES:
        raise ValueError(f"{len(rules)} rules are too many for an expression; join them by robots_table.decide")
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    place = F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place))
    found = F.array(*(F.when(place.rlike(regex_of(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(allow).alias("allow"))) for allow, p in rules))
    best = F.array_max(F.filter(found, lambda x: x.isNotNull()))
    return F.coalesce(best["allow"], F.lit(True))


def outcome(status: Column, error: Column) -> Column:
    """parsed, allow-all or unavailable from the last response of robots.txt."""
    return F.when(error.isNotNull(), "unavailable").when(status.between(200, 299), "parsed").when(status.between(400, 499) & (status != 429), "allow-all").otherwise("unavailable")


def gap_ms(outcome: Column, delay_s: Column, min_interval: Column) -> Column:
    asked = delay_s * 1000
    own = (outcome == "parsed") & delay_s.isNotNull() & (asked > min_interval)
    return F.when(F.coalesce(own, F.lit(False)), F.least(F.lit(float(DELAY_CAP_MS)), asked)).otherwise(min_interval).cast("bigint")


@dataclass
class Robots:
    """What the crawl knows about its origin's robots.txt."""

    outcome: str
    status: int | None
    error: str | None
    rules: Rules
    attempts: int = 0


def load(origin: str, token: str, respect: bool, fetch) -> Robots:
    """Follows up to five redirects from the origin's robots.txt; fetch(url) gives a dict or None (404)."""
    if not respect:
        return Robots("not-checked", None, None, Rules())
    from skein.functions import weburl

    at, seen, attempts = f"{origin}/robots.txt", set(), 0

    def none(kind, status=None):
        return Robots("unavailable", status, kind, Rules(), attempts)

    while True:
        if at in seen:
            return none("redirect-loop")
        seen.add(at)
        got = fetch(at) or {"status_code": 404}
        attempts += got.get("attempts") or 1
        if got.get("error_kind"):
            return none(got["error_kind"])
        status = got["status_code"]
        if status in (301, 302, 303, 307, 308):
            if len(seen) > HOPS:
                return none("redirect-limit")
            url = weburl.parse(got.get("location") or "", weburl.parse(at)) if got.get("location") else None
            if url is None or url.user or url.scheme not in ("http", "https"):
                return none("bad-redirect")
            at = str(url)
        elif 200 <= status < 300:
            body = got.get("body") or ""
            if len(body.encode()) > ROBOTS_BYTES:
                return none("too-large")
            return Robots("parsed", status, None, parse(body, token), attempts)
        elif 400 <= status < 500 and status != 429:
            return Robots("allow-all", status, None, Rules(), attempts)
        else:
            return none("http-status", status)


def path_of(url: str) -> str:
    parts = urlsplit(url)
    return (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
