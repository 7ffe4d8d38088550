"""Title and text of regular pages, as native expressions; operators.clean reads any markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import normalised, squeezed, without_footnotes

#: Elements that go with their content, and the references that regular pages use.
DROPPED = ["script", "style", "noscript", "header", "footer", "nav", "aside", "form"]
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _text(markup: Column) -> Column:
    out = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for reference, char in REFERENCES:
        out = F.replace(out, F.lit(reference), F.lit(char))
    return out


def title(html: Column) -> Column:
    """The first h1, else the title."""
    whole = F.coalesce(html, F.lit(""))
    heading = normalised(_text(F.regexp_extract(whole, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    return F.when(heading != "", heading).otherwise(normalised(_text(F.regexp_extract(whole, r"(?is)<title[^>]*>(.*?)</title>", 1))))


def text(html: Column) -> Column:
    """The body's text without DROPPED elements, comments, tags and footnote marks."""
    out = F.coalesce(html, F.lit(""))
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)^.*?<body[^>]*>", "")
    return without_footnotes(squeezed(_text(out)))
