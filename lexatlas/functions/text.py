"""String columns: trimming, URIs, sense keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as an http(s) or ftp(s) address inside angle brackets.
URL_PATTERN = (
    r"(?i)^(?:http|ftp)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space (Spark's trim knows only the blank)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def is_uri(c: Column | str) -> Column:
    """``<...>`` around an http, https, ftp or ftps address; false for an empty string."""
    c = col(c)
    return c.startswith("<") & c.endswith(">") & F.substring(c, F.lit(2), F.length(c) - 2).rlike(URL_PATTERN)


def unwrap(c: Column | str) -> Column:
    """The address without its angle brackets."""
    return F.regexp_replace(col(c), "^<|>$", "")


def local_name(c: Column | str) -> Column:
    """Last path segment of an unwrapped address."""
    return F.substring_index(unwrap(c), "/", -1)


def without_sense(c: Column | str) -> Column:
    """``uri##2`` -> ``uri``."""
    return F.substring_index(col(c), "##", 1)


def split_key(c: Column | str) -> tuple[Column, Column]:
    """(surface, tag) of ``surface::tag``."""
    parts = F.split(col(c), "::")
    return parts[0], F.element_at(parts, -1)
