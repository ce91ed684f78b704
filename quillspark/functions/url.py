"""URL functions: sites, crawl keys, titles, assets, robots rules, addresses."""

from __future__ import annotations

import re
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path endings that are not pages.
ASSET_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "avif",
    "css", "js", "mjs", "map", "woff", "woff2", "ttf", "otf", "eot",
    "zip", "gz", "tar", "rar", "7z", "dmg", "exe", "apk",
    "mp4", "webm", "mp3", "wav", "avi", "mov",
    "xml", "rss", "atom", "json",
)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def effective_port(url: Column) -> Column:
    """The port written, else 443 for https and 80 for others."""
    written = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    return F.when(written != "", written).when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", "443").otherwise("80")


def same_site(root: Column, candidate: Column) -> Column:
    """Same host, whatever its case, and same effective port."""
    return (host(root) == host(candidate)) & (effective_port(root) == effective_port(candidate))


def url_key(url: Column) -> Column:
    """What a crawl knows a page by: host, path without one trailing slash, query; no scheme, port or fragment."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/$", "")
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(host(url), F.when(path == "", "/").otherwise(path), F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def title_from_url(url: Column) -> Column:
    last = F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/", -1), -1)
    return F.when(last == "", F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).otherwise(last)


def is_asset(path: Column) -> Column:
    return F.rlike(path, F.lit(rf"(?i)\.({'|'.join(ASSET_EXTENSIONS)})$"))


def is_textual(content_type: Column) -> Column:
    c = F.lower(content_type)
    return F.startswith(c, F.lit("text/")) | F.contains(c, F.lit("xhtml")) | F.contains(c, F.lit("+xml"))


def origin_allowed(domains: Column, origin: Column) -> Column:
    """Whether the origin's host is listed: bare hosts and full URLs alike, ``www.`` aside; deny by default."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    name = lambda d: F.coalesce(F.nullif(host(d), F.lit("")), d)
    entry = lambda d: bare(name(F.lower(F.trim(d))))
    seen = host(origin)
    return F.coalesce((seen != "") & F.exists(domains, lambda d: (entry(d) != "") & ((entry(d) == seen) | (entry(d) == bare(seen)))), F.lit(False))


def public_ipv4(ip: Column) -> Column:
    """Whether a dotted address is ordinary public unicast; anything else is refused."""
    b = [F.try_to_number(F.get(F.split(ip, r"\."), F.lit(i)), F.lit("999")).cast("int") for i in range(4)]
    valid = F.rlike(ip, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & (F.greatest(*b) <= 255)
    private = (
        (b[0] == 0) & (b[1] == 0) & (b[2] == 0) & (b[3] == 0)
        | b[0].isin(10, 127)
        | (b[0] == 172) & b[1].between(16, 31)
        | (b[0] == 192) & (b[1] == 168)
        | (b[0] == 169) & (b[1] == 254)
        | (b[0] == 100) & b[1].between(64, 127)
        | (b[0] == 192) & (b[1] == 0) & (b[2] == 0)
        | (b[0] == 198) & b[1].isin(18, 19)
        | (b[0] >= 224)
    )
    return F.coalesce(valid & ~private, F.lit(False))


@F.pandas_udf(T.BooleanType())
def public_address(addresses: pd.Series) -> pd.Series:
    """``public_ipv4`` for IPv6 too; IPv4 inside IPv6 is unwrapped first."""
    import ipaddress

    carved = [ipaddress.ip_network(n) for n in ("100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4")]

    def ok(text: str | None) -> bool:
        try:
            a = ipaddress.ip_address(text or "")
        except ValueError:
            return False
        a = getattr(a, "ipv4_mapped", None) or a
        if a.version == 6:
            return not (a.is_unspecified or a.is_loopback or a.is_link_local or a.is_multicast or a in ipaddress.ip_network("fc00::/7"))
        if a.is_unspecified or a.is_loopback or a.is_link_local or a.is_multicast or any(a in n for n in carved):
            return False
        return not any(a in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))

    return addresses.map(ok)


def checked_url(url: Column) -> Column:
    """Whether a URL may be fetched: http(s), a host, and a public address where the host is one."""
    scheme, h = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host(url)
    literal = F.rlike(h, F.lit(r"^\d+(\.\d+){3}$"))
    return F.coalesce(scheme.isin("http", "https") & (h != "") & (~literal | public_ipv4(h)), F.lit(False))


def resolved(base: str | None, href: str | None) -> str:
    """Absolute http(s) URL of a link without its fragment; '' for empty, fragment-only and other-scheme links."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return ""
    try:
        full = urldefrag(urljoin(base or "", href)).url
        return full if urlsplit(full).scheme in ("http", "https") else ""
    except ValueError:
        return ""


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolved(b, h) for b, h in zip(base, href, strict=True)])


@F.pandas_udf(T.StringType())
def decode_bytes(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of a body in its declared charset (UTF-8 where none or an unknown one is declared)."""

    def one(raw: bytes | None, kind: str | None) -> str | None:
        found = re.search(r"charset\s*=\s*\"?([\w.:-]+)", kind or "", re.I)
        try:
            return None if raw is None else bytes(raw).decode(found[1] if found else "utf-8", errors="replace")
        except LookupError:
            return bytes(raw).decode("utf-8", errors="replace")

    return pd.Series([one(r, k) for r, k in zip(body, content_type, strict=True)])


ROBOTS_TYPE = "array<struct<path: string, allow: boolean>>"


def robots_rules(body: Column, user_agent: str) -> Column:
    """Struct ``rules, delay`` of the groups that address this agent, else of those for all agents.

    A group of ours counts when it has any rule or delay.  Lines are folded over
    with the state (groups open now, whether agents are still being named).
    """
    agent = user_agent.lower()
    lines = F.filter(
        F.transform(F.split(F.coalesce(body, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*", ""), r"^\s+|\s+$", ""))),
        lambda x: F.contains(x, F.lit(":")),
    )
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    rules = F.array().cast(ROBOTS_TYPE)
    start = F.struct(F.lit(False).alias("all"), F.lit(False).alias("us"), F.lit(True).alias("naming"), rules.alias("all_rules"), rules.alias("us_rules"), F.lit(0.0).alias("all_delay"), F.lit(0.0).alias("us_delay"))

    def step(s: Column, x: Column) -> Column:
        key, value = x["key"], x["value"]
        names = key == "user-agent"
        fresh = names & ~s["naming"]
        group = F.lower(value)
        ours = (group != "") & (group != "*") & F.contains(F.lit(agent), group)
        rule = key.isin("allow", "disallow") & ~((value == "") & (key == "disallow"))
        add = lambda on, old: F.when(rule & on, F.concat(old, F.array(F.struct(value.alias("path"), (key == "allow").alias("allow"))))).otherwise(old)
        wait = lambda on, old: F.when((key == "crawl-delay") & on, lenient_number(value)).otherwise(old)
        return F.struct(
            F.when(names, (~fresh & s["all"]) | (group == "*")).otherwise(s["all"]).alias("all"),
            F.when(names, (~fresh & s["us"]) | ours).otherwise(s["us"]).alias("us"),
            F.when(names, True).when(key.isin("allow", "disallow", "crawl-delay"), False).otherwise(s["naming"]).alias("naming"),
            add(s["all"], s["all_rules"]).alias("all_rules"), add(s["us"], s["us_rules"]).alias("us_rules"),
            wait(s["all"], s["all_delay"]).alias("all_delay"), wait(s["us"], s["us_delay"]).alias("us_delay"),
        )

    def finish(s: Column) -> Column:
        own = (F.size(s["us_rules"]) > 0) | (s["us_delay"] > 0)
        return F.struct(F.when(own, s["us_rules"]).otherwise(s["all_rules"]).alias("rules"), F.when(own, s["us_delay"]).otherwise(s["all_delay"]).alias("delay"))

    return F.aggregate(fields, start, step, finish)


def lenient_number(text: Column) -> Column:
    """The decimal number a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\d*\.?\d*", 0).try_cast("double"), F.lit(0.0))


def effective_delay(configured_ms: int, robots_seconds: Column) -> Column:
    """Milliseconds between fetches: robots may slow a crawl down, to 5 seconds at most."""
    asked = (robots_seconds * 1000).cast("long")
    return F.when(asked > configured_ms, F.least(asked, F.lit(5000))).otherwise(F.lit(configured_ms)).cast("long")


def path_pattern(rule: Column) -> Column:
    """Regular expression of a robots path: each literal at its leftmost place, ``$`` anchors."""
    anchored = F.endswith(rule, F.lit("$"))
    body = F.when(anchored, F.left(rule, F.length(rule) - 1)).otherwise(rule)
    quote = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(body, r"\*", -1)
    later = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    return F.concat(F.lit("(?s)^"), quote(F.get(parts, F.lit(0))), F.array_join(F.transform(later, lambda p: F.concat(F.lit("(?>.*?"), quote(p), F.lit(")"))), ""), F.when(anchored, "\\z").otherwise(""))


def robots_allow(rules: Column, path: Column) -> Column:
    """Whether the longest matching rule allows a path; allow wins ties; no rule allows."""
    p = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    hits = F.filter(rules, lambda r: F.rlike(p, path_pattern(r["path"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
