"""URL operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sub

# Query keys that only track, path patterns of pages of little value, and markers that scores count.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
LOW_VALUE = "/tag/|/tags/|/category/|/categories/|/archive|/archives|/search|/feed|/author/|/comments|/wp-admin|/wp-login"
SOFT_404 = r"\b404\b|not found|page not found|no results"
TOPICS = ("dnd", "d&d", "dungeon", "dragon", "session", "transcript", "play", "report", "campaign", "rpg")
LICENSES = ("copyright", "creative commons", "cc-by", "all rights reserved", "license")
OWNERS = ("about", "contact", "terms", "privacy")
PARTS = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def normalize_url(url: Column) -> Column:
    """Lower scheme and host, no default port, single slashes, no end slash, query sorted without tracking and blank keys, no fragment."""
    part = lambda i: F.regexp_extract(url, PARTS, i)
    scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
    net = F.lower(part(2))
    net = F.when(scheme == "http", sub(net, r":80\z", "")).when(scheme == "https", sub(net, r":443\z", "")).otherwise(net)
    path = sub(F.when(part(3) == "", F.lit("/")).otherwise(part(3)), "/{2,}", "/")
    path = F.when(path != "/", sub(path, r"/\z", "")).otherwise(path)
    pairs = F.filter(F.split(part(4), "&"), lambda kv: kv.rlike("=.") & ~F.lower(F.regexp_extract(kv, "^([^=]*)", 1)).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(scheme, F.lit("://"), net, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def domain_allowed(host_: Column, domains: tuple[str, ...]) -> Column:
    ok = F.lit(False)
    for d in domains:
        ok = ok | (host_ == d) | F.endswith(host_, F.lit(f".{d}"))
    return ok


def path_allowed(url: Column, prefixes: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> Column:
    """Blocked patterns first; then a prefix on a segment boundary; no prefixes allow all."""
    norm = normalize_url(url)
    path = F.regexp_extract(norm, PARTS, 3)
    ok = F.lit(not prefixes)
    for p in prefixes:
        p = p if p == "/" else p.rstrip("/")
        ok = ok | (F.lit(True) if p == "/" else (path == p) | F.startswith(path, F.lit(p + "/")))
    for b in blocked:
        ok = ok & ~norm.rlike(f"(?i){b}")
    return ok


def low_value(url: Column) -> Column:
    return F.lower(normalize_url(url)).rlike(LOW_VALUE)


def soft_404(title: Column, text: Column) -> Column:
    return F.lower(F.concat_ws("\n", title, text)).rlike(SOFT_404)


def marker_count(x: Column, markers: tuple[str, ...]) -> Column:
    return sum((F.contains(x, F.lit(m)).cast("int") for m in markers), F.lit(0))


def markers_in(x: Column, markers: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(x), m))


def score_page(url: Column, title: Column, text: Column, depth: Column, reason: Column, n_words: Column) -> Column:
    low = F.lower(F.concat_ws(" ", url, title, F.substring(text, 1, 500)))
    score = 1.0 + 0.5 * marker_count(low, TOPICS) + F.when(reason == "seed", 1.0).otherwise(0.0) + F.when(depth <= 1, 0.4).otherwise(0.0)
    return F.round(score + F.when(n_words > 200, 0.6).otherwise(0.0) - F.when(low_value(url), 1.2).otherwise(0.0), 4)


def score_domain(domain: Column, url: Column, context: Column) -> tuple[Column, Column]:
    """Relevance and risk of a candidate domain, each between 0 and 1."""
    low = F.lower(F.concat_ws(" ", domain, url, context))
    any_of = lambda *ms: marker_count(low, ms) > 0
    relevance = 0.1 + 0.12 * marker_count(low, TOPICS) + F.when(any_of("official", "blog", "archive"), 0.08).otherwise(0.0)
    risk = 0.1 + 0.1 * marker_count(low, LICENSES) + F.when(any_of("fandom", "wiki"), 0.15).otherwise(0.0)
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
    return clamp(relevance), clamp(risk)
