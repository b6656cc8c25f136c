"""Extraction from HTML and sitemaps as Spark columns."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lekha.functions.text import collapse_whitespace

#: Character references that are undone, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def longest(html: Column, pattern: str) -> Column:
    """The longest of the contents that ``pattern`` captures; empty where none."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit("").cast("string"), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(""))


def container(html: Column, tags: tuple[str, ...] = ("article", "main", "body")) -> Column:
    """Content of the first of ``tags`` that has any, the longest of a tag."""
    return F.coalesce(*[F.nullif(longest(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>"), F.lit("")) for t in tags], html)


def until_marker(text: Column, start: str, ends: tuple[str, ...]) -> Column:
    """From ``start`` to the earliest of ``ends`` after it, case aside; empty
    without a start."""
    at = F.locate(start.lower(), F.lower(text))
    rest = F.substr(text, at, F.length(text))
    lower = F.lower(rest)
    places = F.filter(F.array(*[F.locate(e.lower(), lower) for e in ends]), lambda x: x > 0)
    stop = F.when(F.size(places) > 0, F.array_min(places) - 1).otherwise(F.length(rest))
    return F.when(at > 0, F.substr(rest, F.lit(1), stop)).otherwise(F.lit(""))


def without_scripts(html: Column) -> Column:
    """Without scripts, styles and comments, scripts first, as comments may hide
    in them."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


def unescape(text: Column) -> Column:
    for a, b in REFERENCES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plain_text(html: Column) -> Column:
    """Text of HTML: block ends as line feeds, other tags as blanks."""
    out = F.regexp_replace(without_scripts(html), r"(?i)</(p|div|h[1-6]|li|tr)>|<br[^>]*>", "\n")
    return collapse_whitespace(unescape(F.regexp_replace(out, r"<[^>]+>", " ")))


def title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(inner, r"<[^>]+>", " ")), r"[ \t\n]+", " "))


def links(html: Column, suffix: str = "") -> Column:
    """Different targets of links, those that end in ``suffix``."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="([^"]+{suffix})"'), F.lit(1)))


def locations(sitemap: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sitemap, F.lit(r"<loc>([^<]+)</loc>"), F.lit(1)))


def file_name(url: Column) -> Column:
    """A safe file name from a URL's last part; 16 digits of its hash where that is
    empty."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    safe = F.regexp_replace(last, r"[^\p{L}\p{N}._-]", "_")
    return F.when(safe == "", F.substring(F.sha2(url, 256), 1, 16)).otherwise(safe)


def rescued(text: Column, other: Column, per_1000: float = 1.0) -> Column:
    """``other`` where the text has more than so many U+FFFD a thousand characters
    and ``other`` has fewer."""
    bad = lambda c: F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when((bad(text) / F.greatest(F.lit(1), F.length(text)) * 1000 > per_1000) & (bad(other) < bad(text)), other).otherwise(text)


class _Markdown(HTMLParser):
    """HTML as Markdown with ATX headings; navigation and forms left out."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "iframe", "button", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong") and not self.skip:
            self.out.append("**")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    """Markdown of HTML; no built-in parses tags in order."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        p = _Markdown()
        p.feed(h)
        lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
        text = "\n".join(lines)
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
        return text.strip()

    return html.map(one)
