"""Links of pages: which to follow, which are articles, and what category an address has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.rules import first_match

# Addresses that lead to no page, and parts of addresses that hold no articles.
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")
NO_ARTICLE = ("/sport", "/entertainment", "/lifestyle", "/login", "/subscribe", "/premium", "/video")
#: Categories of news by a part of the address, first match first, and what others get.
NEWS = (
    ("markets", "market_news"), ("economy", "economic_news"), ("corporate", "corporate_news"), ("money", "personal_finance_news"),
    ("opinion", "opinion"), ("business", "business_news"),
)
NEWS_DEFAULT = "financial_news"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host(url: Column) -> Column:
    """The host with its port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def join_url(base: Column, href: Column) -> Column:
    """The address that a link on a page leads to; `.` and `..` at the beginning of a link's path are resolved."""
    href = F.trim(href)
    scheme = F.regexp_extract(base, _SCHEME, 0)
    site = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    # One step up for each `../` at the front; none beyond the root.
    up = F.size(F.split(F.regexp_extract(href, r"^(?:\./)*((?:\.\./)*)", 1), r"\.\./")) - 1
    rest = F.regexp_replace(href, r"^(?:\.\.?/)+", "")
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    at = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, "/").otherwise(""))
    return (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#") | href.startswith("?") | (href == ""), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(site, at, rest))
    )


def excluded(url: Column, patterns: Column) -> Column:
    """Whether any of the patterns (an array of regular expressions) occurs in the address, in any case."""
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.regexp_like(F.lower(url), F.lower(p)))


def is_followed(href: Column, full: Column, base: Column, patterns: Column) -> Column:
    """Links to pages of the same host that no pattern excludes; null links are not followed."""
    bare = F.trim(F.coalesce(href, F.lit("")))
    page = bare != ""
    for start in NO_PAGE:
        page = page & ~bare.startswith(start)
    return page & (host(full) == host(base)) & ~excluded(full, patterns)


def is_article(text: Column, full: Column, base: Column) -> Column:
    """Links of 15 characters of text or more to the same host, outside the parts that hold no articles."""
    kept = (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 15) & (host(full) == host(base))
    for part in NO_ARTICLE:
        kept = kept & ~F.contains(F.lower(full), F.lit(part))
    return F.coalesce(kept, F.lit(False))


def has_keyword(text: Column, full: Column, keywords: Sequence[str], least: int = 0) -> Column:
    """Links of more than `least` characters of text with a keyword in the text or in the address, in any case."""
    low = F.lower(F.concat_ws(" ", text, full))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(low, F.lit(word))
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) > least) & hit


def category(url: Column, rules: Sequence[tuple[str, str]] = NEWS, default: str = NEWS_DEFAULT) -> Column:
    """The category of the first rule whose key the path contains; rules are a parameter, one list for each kind of site."""
    return first_match(F.lower(path(url)), rules, default)
