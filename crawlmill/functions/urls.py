"""Parts, order and joining of URLs, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlmill.constants import TRAVERSAL_SIGNS

_IP = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\]|.*:.*)$"


def origin(url: Column) -> Column:
    """scheme://authority, or an empty text."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))


def path(url: Column) -> Column:
    """The path, `/` where there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def extension(url: Column) -> Column:
    """Last dot part of the last path segment; null where it has fewer than two parts that are not empty."""
    parts = F.filter(F.split(F.element_at(F.split(path(url), "/"), -1), r"\."), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def depth(url: Column) -> Column:
    """Slashes of the path with one at its end; 0 where there is no host."""
    p = path(url)
    p = F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
    return F.when(origin(url) == "", F.lit(0)).otherwise(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("int")


def normalized(url: Column) -> Column:
    """One slash at the end."""
    return F.concat(F.rtrim(url, F.lit("/")), F.lit("/"))


def in_scope(host_name: Column, scope_host: Column) -> Column:
    """Equal hosts, or a strict sub-domain by labels; addresses match only if equal."""
    h, s = F.rtrim(F.lower(host_name), F.lit(".")), F.rtrim(F.lower(scope_host), F.lit("."))
    return (h == s) | (h.endswith(F.concat(F.lit("."), s)) & ~s.rlike(_IP))


def is_valid(url: Column) -> Column:
    """Has a scheme, an authority and a host."""
    return F.coalesce(host(url) != "", F.lit(False))


def has_traversal(url: Column) -> Column:
    """A sign of path traversal in the lower-case raw path."""
    p = F.lower(path(url))
    out = F.lit(False)
    for sign in TRAVERSAL_SIGNS:
        out = out | F.contains(p, F.lit(sign))
    return out


_REFERENCE = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?", re.S)


def _without_dots(path: str) -> str:
    """The path without its `.` and `..` segments; empty segments stay."""
    rooted, out = path.startswith("/"), []
    segments = path.split("/")[rooted:]
    for i, s in enumerate(segments):
        if s == "..":
            del out[-1:]
        if s not in (".", ".."):
            out.append(s)
        elif i == len(segments) - 1:
            out.append("")
    return "/" * rooted + "/".join(out)


def resolve_reference(base: str, link: str) -> str:
    """A reference resolved against an absolute URL, by the rules of RFC 3986."""
    b_scheme, b_host, b_path, b_query, _ = _REFERENCE.fullmatch(base).groups()
    scheme, host, path, query, fragment = _REFERENCE.fullmatch(link).groups()
    if scheme is None and host is None:
        if not path:
            path, query = b_path, query if query is not None else b_query
        elif not path.startswith("/"):
            path = (b_path[: b_path.rfind("/") + 1] if b_path or b_host is None else "/") + path
        host = b_host
    path = _without_dots(path)
    scheme = scheme if scheme is not None else b_scheme
    return ("" if scheme is None else scheme + ":") + ("" if host is None else "//" + host) + path + (query or "") + (fragment or "")


@F.pandas_udf(StringType())
def _resolved(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for base, link in pairs:
        yield pd.Series([None if b is None or x is None else resolve_reference(b, x) for b, x in zip(base, link)])


_SPECIAL = r"(^|/)\.\.?(/|$)|^[A-Za-z][A-Za-z0-9+.-]*:|^//|^[?#]|^$"


def join_fast(base: Column, link: Column) -> Column:
    """base and link joined where the link has no dot segments, scheme or host; null elsewhere."""
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "") == "", F.concat(plain, F.lit("/"))).otherwise(F.regexp_extract(plain, r"^(.*/)", 1))
    joined = F.when(link.startswith("/"), F.concat(origin(base), link)).otherwise(F.concat(folder, link))
    return F.when(~link.rlike(_SPECIAL), joined)


def join(base: Column, link: Column) -> Column:
    """Standard reference resolution; only links that need it leave the JVM."""
    special = link.rlike(_SPECIAL)
    return F.when(special, _resolved(F.when(special, base), F.when(special, link))).otherwise(join_fast(base, link))


def prefixes(url: Column) -> Column:
    """(prefix, place) for every slash of the url: what stands before it, longest last."""
    parts = F.split(url, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), n.alias("place")))
