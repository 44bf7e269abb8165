"""Cleaning and measuring of text as column expressions; null texts stay null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and their replacements, patterns, abbreviations.
ONE_TO_ONE = ("’‘“”– ", "''\"\"- ")
LONGER = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("—", "--"), ("…", "..."), ("​", ""), ("﻿", ""))
CURRENCY = r"(?iU)\b(?:K[Ss][Hh]s?\.?|Kshs\.?|K\.?Sh\.?)\s*"
SHILLINGS = r"(?iU)\bKenyan?\s+Shillings?\b"
FILLERS = r"(?i)\b(um|uh|er|ah)\b[\s,]*(?:\b\1\b[\s,]*){2,}"
PAGE_EDGES = (
    r"^Page\s+\d+\s*(of\s+\d+)?$", r"^\d+\s*$", r"^www\.\S+\.\w{2,3}$", r"^©\s*\d{4}", r"^CONFIDENTIAL\s*$", r"^RESTRICTED\s*$",
    r"^CENTRAL BANK OF KENYA$", r"^NAIROBI SECURITIES EXCHANGE$", r"^KENYA REVENUE AUTHORITY$", r"^CAPITAL MARKETS AUTHORITY$",
)
ABBREVIATIONS = {
    "CBK": "Central Bank of Kenya (CBK)", "CBR": "Central Bank Rate (CBR)", "NSE": "Nairobi Securities Exchange (NSE)",
    "KRA": "Kenya Revenue Authority (KRA)", "CMA": "Capital Markets Authority (CMA)",
    "KNBS": "Kenya National Bureau of Statistics (KNBS)", "SASRA": "SACCO Societies Regulatory Authority (SASRA)",
    "NSSF": "National Social Security Fund (NSSF)", "NHIF": "National Hospital Insurance Fund (NHIF)",
    "PAYE": "Pay As You Earn (PAYE)", "VAT": "Value Added Tax (VAT)", "GDP": "Gross Domestic Product (GDP)",
    "CPI": "Consumer Price Index (CPI)", "MPR": "Monetary Policy Rate (MPR)", "MPC": "Monetary Policy Committee (MPC)",
    "NPL": "Non-Performing Loans (NPL)", "T-Bill": "Treasury Bill (T-Bill)", "T-Bond": "Treasury Bond (T-Bond)",
}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def over_lines(text: Column, change) -> Column:
    return let(lines_of(text), lambda a: F.array_join(change(a), "\n"))


def fix_characters(text: Column) -> Column:
    """Ligatures, quotes, dashes, ellipsis, odd spaces, NUL."""
    text = F.translate(text, *ONE_TO_ONE)
    for old, new in LONGER:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.replace(text, F.lit("\x00"), F.lit(""))


def fix_currency(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CURRENCY, "KES "), SHILLINGS, "KES")


def fix_spaces(text: Column) -> Column:
    """Tabs, runs of spaces, more than one blank line, spaces at line ends; in this order."""
    text = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit("    ")), r"(?U)[^\S\n]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return over_lines(text, lambda a: F.transform(a, lambda t: F.regexp_replace(t, r"(?U)\s+$", "")))


def drop_short_lines(text: Column, least: int = 2) -> Column:
    """Lines of under `least` characters go, blank ones stay."""

    def keep(t: Column) -> Column:
        n = F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
        return (n == 0) | (n >= least)

    return over_lines(text, lambda a: F.filter(a, keep))


def drop_rules(text: Column) -> Column:
    """Lines made of five or more signs of decoration become blank."""
    return F.regexp_replace(text, r"(?md)^[=\-_*~.]{5,}$", "")


def expand_abbreviations(text: Column) -> Column:
    """The first occurrence of each abbreviation is spelt out; later entries see what earlier ones wrote."""
    for short, long in ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?sU)^(.*?)\b{short}\b", f"$1{long}")
    return text


def clean(text: Column, normalize: bool = True, currency: bool = True, characters: bool = True, abbreviations: bool = False, least: int = 2) -> Column:
    """The whole cleaning chain."""
    if normalize:
        text = nfkc(text)
    if characters:
        text = fix_characters(text)
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    if currency:
        text = fix_currency(text)
    text = drop_rules(drop_short_lines(fix_spaces(text), least))
    if abbreviations:
        text = expand_abbreviations(text)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_for_embedding(text: Column, **options) -> Column:
    """Cleaned, without page marks, addresses and mails, on one line."""
    text = clean(text, **options)
    text = F.regexp_replace(text, r"(?iU)\bpage\s+\d+\b", "")
    text = F.regexp_replace(text, r"https?://\S+", "")
    text = F.regexp_replace(text, r"\S+@\S+\.\S+", "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_repeated_lines(text: Column) -> Column:
    """Consecutive equal lines (trimmed) are kept once; a blank line starts anew."""

    def kept(a: Column) -> Column:
        return F.filter(a, lambda t, i: (F.trim(t) == "") | (i == 0) | (F.trim(t) != F.trim(F.coalesce(F.get(a, i - 1), F.lit("")))))

    return over_lines(text, kept)


def clean_transcript(text: Column) -> Column:
    """Marks, times, entities and fillers of captions go; four sentences make a paragraph."""
    text = F.regexp_replace(text, r"(?U)\[[\w\s]+\]", " ")
    text = F.regexp_replace(text, r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b", " ")
    text = F.regexp_replace(F.replace(text, F.lit("&amp;"), F.lit("&")), r"&#\d+;", " ")
    text = drop_repeated_lines(clean(text))
    text = F.trim(F.regexp_replace(text, FILLERS, "$1 "))

    def paragraphs(sentences: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sentences) / 4).cast("int") - 1, F.lit(0))),
            lambda g: F.array_join(F.slice(sentences, g * 4 + 1, 4), " "),
        )
        return F.array_join(groups, "\n\n")

    return let(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != ""), paragraphs)


def clean_page(text: Column) -> Column:
    """Running headers and footers of a page go; wide gaps and blank runs shrink."""
    edge = "(?iU)" + "|".join(f"(?:{p})" for p in PAGE_EDGES)
    text = over_lines(text, lambda a: F.filter(a, lambda t: ~F.trim(t).rlike(edge)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, " {4,}", "  "), r"\n{4,}", "\n\n\n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def safe_filename(name: Column, longest: int = 120) -> Column:
    name = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), r"^[_.]+|[_.]+$", "")
    name = F.when(F.length(name) > longest, F.regexp_replace(F.substring(name, 1, longest), "_+$", "")).otherwise(name)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed"))


def date_hint(text: Column) -> Column:
    """The first date in the first 200 characters: day/month/year, month and year, or any four digits."""
    head = F.substring(text, 1, 200)
    patterns = (
        r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})",
        r"(\d{4})",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in patterns])


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def file_kind(url: Column) -> Column:
    """`pdf`, `sheet` or `page`, by the end of the path."""
    low = F.lower(url)
    ext = F.regexp_extract(low, r"\.([a-z]+)(\?|$)", 1)
    return F.when(ext == "pdf", "pdf").when(ext.isin("xlsx", "xls", "csv"), "sheet").otherwise("page")


def link_title(text: Column, url: Column) -> Column:
    """The link's text, or the last part of the path as words if the text is under three characters."""
    part = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), r"(?i)\.pdf$", "")
    return F.when(F.length(F.trim(text)) >= 3, F.trim(text)).otherwise(F.initcap(F.translate(part, "-_", "  ")))
