"""Queries over urls, pages and source filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import html as HT
from ..functions import text as T
from ..functions import urls as U
from ..operators import ranges

_TRACK = ", ".join(f"'{k}'" for k in U.TRACKING)


def _norm(url: str) -> str:
    part = lambda i: f"regexp_extract({url}, '{U.PARTS}', {i})"
    scheme = f"(CASE WHEN {part(1)} = '' THEN 'https' ELSE lower({part(1)}) END)"
    net = f"(CASE {scheme} WHEN 'http' THEN regexp_replace(lower({part(2)}), ':80\\z', '') WHEN 'https' THEN regexp_replace(lower({part(2)}), ':443\\z', '') ELSE lower({part(2)}) END)"
    raw = f"regexp_replace(CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, '/{{2,}}', '/', 'g')"
    path = f"(CASE WHEN {raw} = '/' THEN '/' ELSE regexp_replace({raw}, '/\\z', '') END)"
    pairs = f"array_to_string(list_sort(list_filter(string_split({part(4)}, '&'), lambda kv: regexp_matches(kv, '=.') AND lower(regexp_extract(kv, '^([^=]*)', 1)) NOT IN ({_TRACK}))), '&')"
    return f"({scheme} || '://' || {net} || {path} || CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END)"


_URLS = f"WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/tag//x/?b=2&a=1&utm_source=z&e=' WHEN 1 THEN ':80//q/' WHEN 2 THEN '' ELSE '#frag' END AS url, html FROM pages), n AS (SELECT *, {_norm('url')} AS norm FROM u) "


def _urls(t: Tables) -> DataFrame:
    tail = F.element_at(F.array(F.lit("/tag//x/?b=2&a=1&utm_source=z&e="), F.lit(":80//q/"), F.lit(""), F.lit("#frag")), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", F.concat("url", tail).alias("url"), "html")


@query(_URLS + f"SELECT page_id, norm, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host, substr(sha1(norm), 1, 16) AS url_hash FROM n")
def url_normalized(t: Tables) -> DataFrame:
    norm = U.normalize_url(F.col("url"))
    return _urls(t).select("page_id", norm.alias("norm"), U.host(F.col("url")).alias("host"), F.substring(F.sha1(norm), 1, 16).alias("url_hash"))


_PATH_OF = f"regexp_extract(norm, '{U.PARTS}', 3)"


@query(_URLS + f"SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 2)) LIKE '%.example.com' OR lower(regexp_extract(url, '{U.PARTS}', 2)) = 'example.com' AS domain_ok, NOT regexp_matches(norm, '(?i)/q') AND ({_PATH_OF} = '/en' OR {_PATH_OF} LIKE '/en/%' OR {_PATH_OF} = '/fr' OR {_PATH_OF} LIKE '/fr/%') AS path_ok FROM n")
def url_scope(t: Tables) -> DataFrame:
    return _urls(t).select("page_id", U.domain_allowed(U.host(F.col("url")), ("example.com",)).alias("domain_ok"), U.path_allowed(F.col("url"), ("/en/", "/fr"), ("/q",)).alias("path_ok"))


@query(_URLS + f"SELECT page_id, regexp_matches(lower(norm), '{U.LOW_VALUE}') AS low FROM n")
def url_low_value(t: Tables) -> DataFrame:
    return _urls(t).select("page_id", U.low_value(F.col("url")).alias("low"))


_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query(f"WITH d AS (SELECT doc_id, 'x' || CASE doc_id % 5 WHEN 0 THEN ' 404 ' WHEN 1 THEN ' page Not Found' ELSE '' END AS title, text FROM documents) SELECT doc_id, regexp_matches(lower(title || chr(10) || text), '(?:^|[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}])404(?:$|[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}])|not found|page not found|no results') OR {_WORDS} < 120 AS low FROM d")
def page_low_value(t: Tables) -> DataFrame:
    title = F.concat(F.lit("x"), F.when(F.col("doc_id") % 5 == 0, " 404 ").when(F.col("doc_id") % 5 == 1, " page Not Found").otherwise(""))
    return t.documents.select("doc_id", (U.soft_404(title, F.col("text")) | (T.word_count("text") < 120)).alias("low"))


def _links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, host): normalised targets of a page's anchors; relative ones on the page's host."""
    base = F.concat(F.lower(F.regexp_extract("url", U.PARTS, 1)), F.lit("://"), F.regexp_extract("url", U.PARTS, 2))
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", base.alias("base"), F.posexplode(hrefs).alias("pos", "href"))
    full = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).otherwise(F.concat("base", "href"))
    return rows.select("page_id", "pos", U.normalize_url(full).alias("url")).withColumn("host", U.host(F.col("url")))


_LINKS = f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 1)) || '://' || regexp_extract(url, '{U.PARTS}', 2) AS base, regexp_extract_all(html || '<a href="http://Other.example.org/a/?ref=1">', '<a href="([^"]*)"', 1) AS hs FROM pages),
e AS (SELECT page_id, base, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM h), f AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href ELSE base || href END AS full_url FROM e),
l AS (SELECT page_id, pos, {_norm('full_url')} AS url FROM f), k AS (SELECT *, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host FROM l) """


def _with_other(t: Tables) -> DataFrame:
    return t.pages.withColumn("html", F.concat("html", F.lit('<a href="http://Other.example.org/a/?ref=1">')))


@query(_LINKS + f"SELECT page_id, url, min(pos)::INT AS pos FROM k WHERE NOT regexp_matches(lower(url), '{U.LOW_VALUE}') GROUP BY page_id, url")
def page_links(t: Tables) -> DataFrame:
    return _links(_with_other(t)).filter(~U.low_value(F.col("url"))).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


@query(_LINKS + "SELECT page_id, host, url FROM k WHERE NOT (host LIKE '%.example.com' OR host LIKE '%.example.net') QUALIFY row_number() OVER (PARTITION BY page_id, host ORDER BY pos) = 1")
def link_candidates(t: Tables) -> DataFrame:
    outside = _links(_with_other(t)).filter(~U.domain_allowed(F.col("host"), ("example.com", "example.net")))
    return outside.groupBy("page_id", "host").agg(F.min_by("url", "pos").alias("url"))


@query()
def page_main_text(t: Tables) -> DataFrame:
    return HT.extract(t.pages).select("page_id", "title", "text", "extractor")


@query()
def html_stripped_text(t: Tables) -> DataFrame:
    return HT.extract(t.pages).select("page_id", "full_text")


def _hits(x: str, ms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{m}')::INT" for m in ms) + ")"


@query(
    f"""WITH d AS (SELECT page_id, url, 'Session Report' AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, page_id % 3 AS depth, CASE page_id % 2 WHEN 0 THEN 'seed' ELSE 'link' END AS reason, {_norm('url')} AS norm FROM pages),
    l AS (SELECT *, lower(url || ' ' || title || ' ' || substr(text, 1, 500)) AS low FROM d)
    SELECT page_id, round((1.0 + 0.5 * {_hits('low', U.TOPICS)} + CASE reason WHEN 'seed' THEN 1.0 ELSE 0 END + CASE WHEN depth <= 1 THEN 0.4 ELSE 0 END + CASE WHEN {_WORDS} > 200 THEN 0.6 ELSE 0 END - CASE WHEN regexp_matches(lower(norm), '{U.LOW_VALUE}') THEN 1.2 ELSE 0 END)::DOUBLE, 4) AS score FROM l"""
)
def page_scores(t: Tables) -> DataFrame:
    d = t.pages.select("page_id", "url", T.sub("html", "<[^>]*>", " ").alias("text"))
    reason = F.when(F.col("page_id") % 2 == 0, "seed").otherwise("link")
    return d.select("page_id", U.score_page(F.col("url"), F.lit("Session Report"), F.col("text"), F.col("page_id") % 3, reason, T.word_count("text")).alias("score"))


@query(
    f"""WITH d AS (SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host, url, 'Official campaign wiki, license and copyright' || CASE page_id % 2 WHEN 0 THEN ' about privacy' ELSE '' END AS ctx FROM pages), l AS (SELECT *, lower(host || ' ' || url || ' ' || ctx) AS low FROM d)
    SELECT page_id, round(greatest(0.0, least(1.0, (0.1 + 0.12 * {_hits('low', U.TOPICS)} + CASE WHEN {_hits('low', ('official', 'blog', 'archive'))} > 0 THEN 0.08 ELSE 0 END)::DOUBLE)), 4) AS relevance,
    round(greatest(0.0, least(1.0, (0.1 + 0.1 * {_hits('low', U.LICENSES)} + CASE WHEN {_hits('low', ('fandom', 'wiki'))} > 0 THEN 0.15 ELSE 0 END)::DOUBLE)), 4) AS risk,
    array_to_string(list_filter(['copyright', 'creative commons', 'cc-by', 'all rights reserved', 'license'], lambda m: contains(lower(ctx), m)), ',') AS licenses, array_to_string(list_filter(['about', 'contact', 'terms', 'privacy'], lambda m: contains(lower(ctx), m)), ',') AS owners FROM l"""
)
def domain_scores(t: Tables) -> DataFrame:
    ctx = F.concat(F.lit("Official campaign wiki, license and copyright"), F.when(F.col("page_id") % 2 == 0, " about privacy").otherwise(""))
    relevance, risk = U.score_domain(U.host(F.col("url")), F.col("url"), ctx)
    return t.pages.select("page_id", relevance.alias("relevance"), risk.alias("risk"), F.array_join(U.markers_in(ctx, U.LICENSES), ",").alias("licenses"), F.array_join(U.markers_in(ctx, U.OWNERS), ",").alias("owners"))


@query(f"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*', ''), '/\\z', '') AS canon, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host FROM pages) SELECT page_id, canon, regexp_extract(host, '([^.]+\\.[^.]+)\\z', 1) AS registered, regexp_extract(host, '([^.]+\\.[^.]+)\\z', 1) = 'example.com' AS same FROM p")
def url_canon(t: Tables) -> DataFrame:
    registered = F.regexp_extract(U.host(F.col("url")), r"([^.]+\.[^.]+)\z", 1)
    return t.pages.select("page_id", T.sub(T.sub("url", "#.*", ""), r"/\z", "").alias("canon"), registered.alias("registered"), (registered == "example.com").alias("same"))


@query("WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<?xml version=\"1.0\"?><rss>' WHEN 1 THEN '  <urlset>' ELSE html END AS x FROM pages) SELECT page_id, CASE WHEN regexp_matches(ltrim(lower(x)), '^(<\\?xml|<rss|<feed|<urlset|<sitemapindex|<opml)') THEN 'xml' WHEN contains(lower(substr(x, 1, 200)), '<html') THEN 'html' ELSE 'other' END AS kind FROM p")
def xml_sniff(t: Tables) -> DataFrame:
    x = F.when(F.col("page_id") % 3 == 0, F.lit('<?xml version="1.0"?><rss>')).when(F.col("page_id") % 3 == 1, F.lit("  <urlset>")).otherwise(F.col("html"))
    kind = F.when(F.ltrim(F.lower(x)).rlike(r"^(<\?xml|<rss|<feed|<urlset|<sitemapindex|<opml)"), "xml").when(F.contains(F.lower(F.substring(x, 1, 200)), F.lit("<html")), "html").otherwise("other")
    return t.pages.select("page_id", kind.alias("kind"))


@query("WITH p AS (SELECT page_id, '<meta name=\"dc.title\" content=\"T' || page_id || '\"><meta name=\"dc.creator\" content=\"C\">' || html AS x FROM pages) SELECT page_id, regexp_extract(x, '<meta name=\"dc.title\" content=\"([^\"]*)\"', 1) AS title, regexp_extract(x, '<meta name=\"dc.creator\" content=\"([^\"]*)\"', 1) AS creator, regexp_extract(x, '<html lang=\"([^\"]*)\"', 1) AS lang FROM p")
def book_metadata(t: Tables) -> DataFrame:
    x = F.concat(F.lit('<meta name="dc.title" content="T'), "page_id", F.lit('"><meta name="dc.creator" content="C">'), "html")
    meta = lambda name: F.regexp_extract(x, f'<meta name="{name}" content="([^"]*)"', 1)
    return t.pages.select("page_id", meta("dc.title").alias("title"), meta("dc.creator").alias("creator"), F.regexp_extract(x, '<html lang="([^"]*)"', 1).alias("lang"))


@query(f"WITH p AS (SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host FROM pages), r AS (SELECT host, min(page_id) % 3 AS k FROM p GROUP BY host) SELECT page_id, CASE k WHEN 0 THEN true WHEN 1 THEN false ELSE host LIKE 'www.%' END AS allowed FROM p JOIN r USING (host)")
def robots_gate(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", U.host(F.col("url")).alias("host"))
    robots = p.groupBy("host").agg((F.min("page_id") % 3).alias("k")).filter("k < 2").select("host", (F.col("k") == 0).alias("fetch_ok"))
    return p.join(robots, "host", "left").select("page_id", F.coalesce("fetch_ok", F.startswith("host", F.lit("www."))).alias("allowed"))  # no robots file: only the override list


@query(f"SELECT page_id, regexp_matches(url, '/en/') AND NOT regexp_matches(url, '[?]page=') AS crawl, regexp_matches(lower(html), '<article') AND len(list_filter(string_split_regex(html, '\\s+'), lambda w: w <> '')) > 150 AS likely FROM pages")
def crawl_rules(t: Tables) -> DataFrame:
    return t.pages.select("page_id", (F.col("url").rlike("/en/") & ~F.col("url").rlike("[?]page=")).alias("crawl"), (F.lower("html").rlike("<article") & (T.word_count("html") > 150)).alias("likely"))


@query("WITH u AS (SELECT page_id, list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+')) AS w, url FROM pages) SELECT page_id, (2 * len(list_intersect(w, ['en', 'www', 'html'])) - 3 * len(list_intersect(w, ['ref', 'm'])) + CASE WHEN regexp_matches(url, '\\.html') THEN 4 ELSE 0 END)::BIGINT AS score, score >= 3 AND NOT contains(url, 'page=') AS fetch FROM u")
def download_gate(t: Tables) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))
    hits = lambda *ws: F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))
    score = (2 * hits("en", "www", "html") - 3 * hits("ref", "m") + F.when(F.col("url").rlike(r"\.html"), 4).otherwise(0)).cast("long")
    return t.pages.select("page_id", score.alias("score"), ((score >= 3) & ~F.contains("url", F.lit("page="))).alias("fetch"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a file glob."""
    return r"\A" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in glob) + r"\z"


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_name LIKE 'b%' AND NOT p_name LIKE '%bolt'")
def glob_filter(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.filter(n.rlike(glob_pattern("b*")) & n.rlike(glob_pattern("*e*")) & ~n.rlike(glob_pattern("*bolt"))).select("p_partkey")


def valid_source(path: Column, title: Column, whitelist: str, allowed: tuple[str, ...], denied: tuple[str, ...], parts: tuple[str, ...], names: str) -> Column:
    """A whitelisted path passes; else it needs an allowed suffix, no denied folder and no denied name or title."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]+)?\z", 1)
    ok = suffix.isin(*allowed) & ~suffix.isin(*denied) & ~F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, parts))) & ~stem.rlike(names) & ~title.rlike(names)
    return path.rlike(whitelist) | ok


_FILES = "WITH p AS (SELECT page_id, 'c/' || CASE page_id % 5 WHEN 0 THEN 'logs/a' WHEN 1 THEN 'gold/manifest' WHEN 2 THEN 'x/report' ELSE 'x/page' END || page_id || CASE page_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.exe' ELSE '.txt' END AS path, CASE page_id % 7 WHEN 0 THEN 'Watchdog' ELSE 'A page' END AS title FROM pages) "


@query(_FILES + "SELECT page_id, regexp_matches(path, '^c/gold/') OR (regexp_extract(path, '(\\.[^./]+)\\z', 1) IN ('.json', '.txt') AND NOT contains('/' || path, '/logs/') AND NOT regexp_matches(regexp_extract(path, '([^/]*)\\z', 1), '(?i)^(manifest|report|watchdog)') AND NOT regexp_matches(title, '(?i)^(manifest|report|watchdog)')) AS valid FROM p")
def ingestion_filter(t: Tables) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("c/"), F.when(k % 5 == 0, "logs/a").when(k % 5 == 1, "gold/manifest").when(k % 5 == 2, "x/report").otherwise("x/page"), k, F.when(k % 3 == 0, ".json").when(k % 3 == 1, ".exe").otherwise(".txt"))
    title = F.when(k % 7 == 0, "Watchdog").otherwise("A page")
    return t.pages.select("page_id", valid_source(path, title, "^c/gold/", (".json", ".txt"), (".log",), ("logs",), "(?i)^(manifest|report|watchdog)").alias("valid"))


def matches(column: Column, wanted: list[str], is_list: bool) -> Column:
    """Lists overlap whatever their case; scalars are equal to one of the wanted, case counting."""
    return F.arrays_overlap(F.transform(column, lambda x: F.lower(x)), F.array(*[F.lit(w.lower()) for w in wanted])) if is_list else F.coalesce(column.isin(*wanted), F.lit(False))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src5')")
def tag_filters(t: Tables) -> DataFrame:
    return t.documents.filter(matches(F.array(F.upper("lang")), ["EN", "de"], True) & matches(F.col("source"), ["src1", "src2", "src5"], False)).select("doc_id")


@query(f"WITH p AS (SELECT page_id, lower(regexp_extract(url, '{U.PARTS}', 2)) AS host, page_id * 7 % 50 AS a FROM pages), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY a, page_id) - 1 AS i FROM p) SELECT page_id, (i * 2 + max(a - i * 2) OVER (PARTITION BY host ORDER BY i))::BIGINT AS at FROM o")
def host_schedule(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", U.host(F.col("url")).alias("host"), (F.col("page_id") * 7 % 50).alias("a"))
    placed = ranges.places(p, "host", F.col("a") * 1e12 + F.col("page_id"), ["a", "page_id"])
    late = ranges.running_max(placed, "host", F.col("a") - F.col("i") * 2, "late")
    return late.select("page_id", (F.col("i") * 2 + F.col("late")).cast("long").alias("at"))
