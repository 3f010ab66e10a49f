"""Links, robots paths, sub-paths and directory listings out of response bodies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.constants import BACKUP_SUFFIXES, FILE_EXTENSIONS, PATH_JUNK, ROBOTS_PATHS, SCRIPT_LINKS
from crawlmill.functions import urls
from crawlmill.functions.html import LINK_ATTRIBUTES, html_facts
from crawlmill.storage import written


def attribute_links(pages: DataFrame, key: str, html: str = "text", tags: tuple[str, ...] = tuple(LINK_ATTRIBUTES)) -> DataFrame:
    """(key, tag, link) of the attributes that hold links, by the HTML pass."""
    found = html_facts(pages, key, html, ("links",)).select(key, F.inline("links"))
    return found.where(F.col("tag").isin(list(tags))).select(key, "tag", F.col("value").alias("link"))


def attribute_links_native(pages: DataFrame, key: str, html: str = "text") -> DataFrame:
    """(key, link) of quoted link attributes in well-formed pages, without leaving the JVM. Entities stay as they are."""
    found = [F.regexp_extract_all(F.col(html), F.lit(rf'<{tag}\b[^>]*?\s{name}="([^"]*)"'), 1) for tag, name in LINK_ATTRIBUTES.items()]
    return pages.select(key, F.explode(F.flatten(F.array(*found))).alias("link"))


def script_links(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, link) of quoted links anywhere in the body, quotes trimmed."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(SCRIPT_LINKS), 0))
    return pages.select(key, found.alias("link")).withColumn("link", F.regexp_replace("link", "^['\"]+|['\"]+$", ""))


def robots_paths(pages: DataFrame, key: str, text: str = "text", crlf: bool = False) -> DataFrame:
    """(key, link) of allow and disallow lines. A line that ends in CR LF matches only with crlf, unless in a comment."""
    t = F.regexp_replace(text, "\r\n", "\n") if crlf else F.col(text)
    return pages.select(key, F.explode(F.regexp_extract_all(t, F.lit("(?dm)" + ROBOTS_PATHS), 1)).alias("link"))


def all_links(pages: DataFrame, robots: DataFrame, key: str, html: str = "text", text: str = "text") -> DataFrame:
    """(key, link), distinct: links of attributes, of script text, of directory listings, and paths of robots files.

    The HTML pass runs once for attributes and listings; robots has key and text.
    """
    facts = written(html_facts(pages, key, html), "html-facts")
    attributes = facts.select(key, F.inline("links")).select(key, F.col("value").alias("link"))
    listed = facts.join(listing_kind(facts, key).where("kind is not null").select(key), key, "left_semi").select(key, F.explode("anchors.href").alias("link"))
    found = attributes.unionByName(script_links(pages, key, html)).unionByName(listed).unionByName(robots_paths(robots, key, text))
    return found.where("link is not null").distinct()


def sub_paths(link: Column) -> Column:
    """The cleaned path without slashes at its ends, then each parent with a slash at its end."""
    t = F.regexp_replace(F.regexp_replace(F.trim(link), "^/+", ""), r"(?U)\s", "")
    t = F.when(F.contains(t, F.lit("?")), F.substring_index(t, "?", 1)).otherwise(F.substring_index(t, "#", 1))
    parts = F.filter(F.transform(F.split(t, "/"), lambda p: F.regexp_replace(p, PATH_JUNK, "")), lambda p: p != "")
    n = F.size(parts)
    parents = F.transform(F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(n > 0, F.concat(F.array(F.array_join(parts, "/")), parents)).otherwise(F.array().cast("array<string>"))


def resolved_links(links: DataFrame, scope_hosts: list[str], url: str = "url", mode: str = "reference") -> DataFrame:
    """links (url, link) expanded to sub-paths, joined to their page's url, and kept where in scope; distinct.

    An absolute link in scope adds only its path. In mode "reference" a sub-path joins the page's folder; in "rfc3986"
    the link itself is resolved as browsers do.
    """
    link = F.col("link")
    absolute = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    hosts = F.lit(False)
    for s in scope_hosts:
        hosts = hosts | urls.in_scope(urls.host(link), F.lit(s))
    rows = links.where(~absolute | hosts)
    if mode == "rfc3986":
        full = rows.select(url, urls.join(F.col(url), link).alias("found"))
    else:
        local = F.when(absolute, urls.path(link)).otherwise(link)
        full = rows.select(url, F.explode(sub_paths(local)).alias("sub")).select(url, urls.join(F.col(url), F.col("sub")).alias("found"))
    kept = F.lit(False)
    for s in scope_hosts:
        kept = kept | urls.in_scope(urls.host(F.col("found")), F.lit(s))
    return full.where(kept).distinct()


def _holds(*signs: str) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(s)) for s in signs])


def listing_kind(facts: DataFrame, key: str) -> DataFrame:
    """(key, kind): Apache, TomCatOrPython, AspDotNet or Custom directory listing, or null, from html_facts."""
    titles = F.transform("titles", F.lower)
    by_title = F.lit(None).cast("string")
    for sign, kind in reversed([("directory listing for /", "TomCatOrPython"), ("index of /", "Apache"), ("directory listing -- /", "AspDotNet")]):
        by_title = F.when(F.exists(titles, _holds(sign)), F.lit(kind)).otherwise(by_title)
    up = F.exists("anchors", lambda a: F.lower(F.trim(a["href"])).isin("../", "..") | F.lower(a["text"]).rlike("parent directory|to parent|up to parent"))
    heads = F.transform(F.when(F.size("headers") > 0, F.col("headers")).otherwise(F.col("cells")), F.lower)
    kinds = sum((F.exists(heads, _holds(*p)).cast("int") for p in (["name"], ["size"], ["date", "time", "modified"])), F.lit(0))
    sorts = F.exists("anchors", lambda a: F.coalesce(F.lower(a["href"]).rlike(r"\?c=[nsmd]"), F.lit(False)))
    known = F.array(*[F.lit(e) for e in dict.fromkeys(FILE_EXTENSIONS + BACKUP_SUFFIXES)])
    hrefs = F.filter("anchors", lambda a: a["href"].isNotNull() & ~F.trim(a["href"]).isin("../", "..") & ~F.startswith(a["href"], F.lit("#")))
    entry = F.size(F.filter(hrefs, lambda a: F.endswith(a["href"], F.lit("/")) | F.array_contains(known, F.lower(F.regexp_extract(a["href"], r"(\.[^./?#]+)(?:[?#].*)?$", 1)))))
    signals = F.coalesce(up, F.lit(False)).cast("int") + (kinds >= 2).cast("int") + F.coalesce(sorts, F.lit(False)).cast("int") + (entry >= 3).cast("int")
    return facts.select(key, F.coalesce(by_title, F.when(signals >= 2, F.lit("Custom"))).alias("kind"))


def reachable(edges: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(url, level): what links reach from the targets, each at its least number of steps, up to depth.

    edges is (src_url, link), targets is (url). Edges, which each level joins, and levels are written to the shared folder.
    """
    edges = written(edges, "edges")
    seen = written(targets.select("url").distinct().withColumn("level", F.lit(0)), "reachable")
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select(F.col("url").alias("src_url")).join(edges, "src_url").select(F.col("link").alias("url")).distinct()
        frontier = written(step.join(seen, "url", "left_anti").withColumn("level", F.lit(level)), "reachable-level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
