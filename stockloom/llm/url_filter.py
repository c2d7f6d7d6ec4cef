"""URL filter: allow and block rules, and blocks that spread over redirect and canonical-link aliases.

A rule is a host with a path prefix; it fits the host and its subdomains. The longest rule that fits decides a
URL. URLs that pages name as redirect target (``meta refresh``) or canonical form are aliases; aliases are
the connected components of these edges, found with joins and aggregates. A URL without a rule is blocked if
an alias is blocked by a rule, else allowed; a URL that a rule allows stays allowed.

A URL is identified by its scheme and host in lower case, its path (``/`` if empty) and its query, without the
fragment. Only DataFrame functions are used; the configured rules are a literal in the plan.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule, has no aliases and is
allowed; null or empty HTML names no aliases; links that resolve to the page itself or to something other
than a URL with ``://`` are no edges; repeated rows are judged alike; of rules of the same text the first
counts. Extra columns are kept; columns that are added replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.arrow import fresh
from stockloom.llm.components import connected_components
from stockloom.operators.scans import materialize

URL = "(?s)^(.*?)://([^/?#]*)([^?#]*)"
QUERY = "(?s)^[^?#]*([?][^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"
ADDED = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; ``pattern`` is a host followed by a path prefix that starts with ``/``."""

    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))


def url_host(url: Column) -> Column:
    return lowered(_part(url, 2))


def url_path(url: Column) -> Column:
    return _part(url, 3)


def url_key(url: Column) -> Column:
    """Identity of a URL; null if it has no ``://``."""
    path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    query = F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit(""))
    key = F.concat(lowered(_part(url, 1)), F.lit("://"), url_host(url), path, query)
    return F.when(url.contains("://"), key)


def decision(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of ``rule`` and ``action`` of the longest rule that fits, or null."""
    ordered = sorted(dict.fromkeys(rules), key=lambda r: -len(r.pattern))
    fits = F.lit(None)
    for r in reversed(ordered):
        hit = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        fits = F.when(hit, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.action).alias("action"))).otherwise(fits)
    return fits


def resolved(link: Column, base: Column) -> Column:
    """A link of a page with the URL ``base`` as a full URL."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = _part(base, 1)
    site = F.concat(scheme, F.lit("://"), _part(base, 2))
    folder = F.regexp_extract(url_path(base), "(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, url_path(base), link))
        .when(link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b``: keys of pages and of the URLs that they redirect to or call canonical."""
    html = F.regexp_replace("html", "(?s)<!--.*?-->", " ")
    tags = pages.filter(F.col("html").ilike("%canonical%") | F.col("html").ilike("%refresh%")).select(
        "url",
        F.concat(
            F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
            F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TARGET, 1)),
        ).alias("links"),
    )
    links = tags.select("url", F.explode("links").alias("link")).filter("link != ''")
    keys = links.select(url_key(F.col("url")).alias("a"), url_key(resolved(F.col("link"), F.col("url"))).alias("b"))
    return keys.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key`` of all URLs that are an alias of a URL blocked by a rule. ``edges`` should be stored."""
    members = materialize(connected_components(edges))
    key = F.col("node")
    blocked = members.filter(decision(url_host(key), url_path(key), rules)["action"] == "block")
    return members.join(blocked.select("component").distinct(), "component", "left_semi").select(key.alias("key"))


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every page (``url``, ``html``).

    ``edges`` (``a``, ``b``: URL keys) are further aliases, for example from a redirect log.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select("a", "b"))
    aliases = materialize(blocked_aliases(materialize(found), rules))
    key, hit, own = (fresh(pages, n) for n in ("_key", "_blocked", "_own"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.withColumns({key: url_key(F.col("url")), own: decision(host, path, rules)})
    joined = judged.join(aliases.select(F.col("key").alias(key), F.lit(True).alias(hit)), key, "left")
    spread = F.when(F.col(hit), "block").otherwise("allow")
    rest = [c for c in pages.columns if c not in ADDED]
    return joined.select(
        *rest, host.alias("host"), path.alias("path"), F.col(f"{own}.rule").alias("rule"),
        F.coalesce(F.col(f"{own}.action"), spread).alias("verdict"),
    )
