"""Measures of a response body and tests of a response, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.constants import STATUS_CODES
from crawlmill.functions import urls


def content_length(text: Column, header: Column, truncated: Column) -> Column:
    """The larger of header and body bytes; what was read where a longer body was cut."""
    read = F.octet_length(text).cast("long")
    stated = F.coalesce(header.cast("long"), F.lit(0))
    return F.when(truncated & (stated > read), read).otherwise(F.greatest(stated, read))


def line_count(text: Column) -> Column:
    """Lines ended by a line feed or by the end; a final line feed begins no line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(feeds + 1 - F.endswith(text, F.lit("\n")).cast("int")).cast("long")


def word_count(text: Column) -> Column:
    """Maximal runs without Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def capped_text(body: Column, limit: int) -> Column:
    """The first `limit` bytes as text, invalid bytes replaced."""
    return F.make_valid_utf8(F.substring(body, 1, limit).cast("string"))


def is_truncated(body: Column, limit: int) -> Column:
    return F.octet_length(body) > limit


def status_class(status: Column) -> Column:
    return F.floor(status / 100).cast("int")


def redirect_target(status: Column, url: Column, location: Column) -> Column:
    """Where a redirect leads: its location as a reference of the url; null without one."""
    return F.when((status_class(status) == 3) & location.isNotNull(), urls.join(url, location))


def is_directory(status: Column, url: Column, location: Column) -> Column:
    """A redirect to the same url with a slash, or a success or 403 whose url ends with one."""
    redirected = F.coalesce(redirect_target(status, url, location) == F.concat(url, F.lit("/")), F.lit(False))
    found = ((status_class(status) == 2) | (status == 403)) & url.endswith("/")
    return F.when(status_class(status) == 3, redirected).otherwise(found)


def is_reported(status: Column, filter_status: Sequence[int] = (), status_codes: Sequence[int] = STATUS_CODES) -> Column:
    """Not a filtered status where there are any; else one of the reported ones."""
    return ~status.isin(list(filter_status)) if filter_status else status.isin(list(status_codes))


def with_measures(responses, text: str = "text"):
    """responses with content_length, line_count and word_count of their text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return responses.withColumns({"content_length": F.octet_length(t).cast("long"), "line_count": line_count(t), "word_count": word_count(t)})
