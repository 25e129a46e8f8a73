"""URLs as columns."""

from __future__ import annotations

import html
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Hrefs that are no links.
SKIPPED = ("#", "mailto:", "tel:", "javascript:")
_SKIPPED = "^(#|mailto:|tel:|javascript:)"


def host(url: Column | str) -> Column:
    """Network location in lower case, with port and user; empty where there is none."""
    return F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))


def repair_scheme(url: Column | str) -> Column:
    """``http:/host`` made ``http://host``."""
    return F.regexp_replace(url, "(?i)^(https?):/(?!/)", "$1://")


def without_fragment(url: Column | str) -> Column:
    return F.substring_index(url, "#", 1)


def page_identity(url: Column | str) -> Column:
    """URL of a page of a site: no fragment, no slashes at the end."""
    return F.regexp_replace(without_fragment(url), "/+$", "")


def slug(url: Column | str) -> Column:
    """Last segment of a URL, slashes at its end aside."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def is_link(href: Column | str) -> Column:
    """Whether an href, trimmed, leads anywhere; prefixes count in lower case only."""
    href = F.col(href) if isinstance(href, str) else href
    return (href != "") & ~href.rlike(_SKIPPED)


def join(base: str, href: str) -> str | None:
    """An href resolved against its page and repaired; None if it is malformed."""
    try:
        url = urljoin(base, href)
        urlsplit(url)
    except ValueError:
        return None
    head, colon, rest = url.partition(":")
    if colon and head.lower() in ("http", "https") and rest.startswith("/") and not rest.startswith("//"):
        url = f"{head}:/{rest}"
    return url


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """``join`` as a column; null where either side is null or the href is malformed."""
    return pd.Series([None if b is None or h is None else join(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded; null stays null."""
    return pd.Series([None if t is None else html.unescape(t) for t in text], dtype=object)
