"""Text functions as Spark columns.

Patterns are written so that Java and RE2 read them alike: white space and letter
classes are explicit, as ``\\s`` and ``\\b`` differ between engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space of Unicode, as a character class.
SPACE = r"[\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Punctuation that is made plain.
PLAIN = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("\u00a0", " "), ("\u200b", ""), ("\ufeff", ""))

#: Words that lost an i, and endings that did.
LOST_I = (("Artcles", "Articles"), ("artcles", "articles"), ("fnal", "final"), ("Fnal", "Final"), ("Defniton", "Definition"), ("defniton", "definition"), ("afrmaton", "affirmation"), ("Afrmaton", "Affirmation"))
LOST_ENDINGS = (("aton", "ation"), ("iton", "ition"), ("cton", "ction"), ("tng", "ting"))

#: Categories whose pages are no subject matter.
CRUFT = ("advertizement", "advertisement", "download", "noticeboard", "notice-board", "top-10")

DEVANAGARI = r"[\x{0900}-\x{097F}]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; no built-in has it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain_punctuation(text: Column) -> Column:
    """Curly quotes, dashes, ellipses and odd blanks made plain; U+FFFD after a digit
    or ASCII letter becomes a full stop, others go."""
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), PLAIN, text)
    out = F.regexp_replace(out, "([0-9A-Za-z])\\x{FFFD}", "$1.")
    return F.replace(out, F.lit("�"), F.lit(""))


def normalize_unicode(text: Column) -> Column:
    """NFKC, then plain punctuation."""
    return plain_punctuation(nfkc(text))


def strip_strikethrough(text: Column) -> Column:
    """A struck capital joins the word after it; other struck text loses its marks."""
    out = F.regexp_replace(text, f"~~([A-Z])~~{SPACE}+", "$1")
    return F.replace(F.regexp_replace(out, r"~~([^~\n]+)~~", "$1"), F.lit("~~"), F.lit(""))


def restore_lost_i(text: Column) -> Column:
    """Words that a font lost an i of: the listed ones, and words of four letters or
    more in -aton, -iton, -cton, -tng, but for automaton, triton and briton."""
    edge = r"(^|[^A-Za-z0-9_])"
    out = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), LOST_I, text)
    keep = "(?!(?i:automaton|triton|briton)(?![A-Za-z0-9_]))"
    return reduce(lambda c, p: F.regexp_replace(c, rf"{edge}{keep}([A-Za-z]{{2,}}){p[0]}(?![A-Za-z0-9_])", f"$1$2{p[1]}"), LOST_ENDINGS, out)


def strip_ends(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks as one blank, none after a line feed, at most one empty line."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return strip_ends(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """The whole cleaning of a document."""
    return collapse_whitespace(restore_lost_i(strip_strikethrough(normalize_unicode(text))))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def devanagari_ratio(text: Column) -> Column:
    """Devanagari characters against letters; may pass 1, as vowel signs are no
    letters. 0 where there are no letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(DEVANAGARI)) / letters).otherwise(F.lit(0.0))


def strip_devanagari(text: Column) -> Column:
    """Runs of Devanagari, with the blanks and stops in them, as one blank; then
    blanks collapsed. Line feeds stay."""
    out = F.regexp_replace(text, r"[\x{0900}-\x{097F}][\x{0900}-\x{097F} \t\x{0964}\x{0965}]*", " ")
    return F.regexp_replace(out, "[ \t]+", " ")


def one_line(text: Column, lower: bool = True, strip: bool = True) -> Column:
    """White space runs as one blank: the form in which texts are hashed."""
    out = F.regexp_replace(text, f"{SPACE}+", " ")
    out = F.trim(out) if strip else out
    return F.lower(out) if lower else out


def digest(text: Column, size: int = 16) -> Column:
    """First hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, size)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_ids(words: Column, size: int = 50_000) -> Column:
    """A deterministic id from 2 to ``size`` - 1 for each word, by its hash; 0 and 1 are
    left for frames. A stand-in for a tokenizer's vocabulary."""
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % (size - 2) + 2).cast("int"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used: an
    expression inside a lambda would else run again for each element."""
    return F.transform(F.array(value), body)[0]


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items, joined by blanks; none where there are fewer."""
    return bind(items, lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))).otherwise(F.array().cast("array<string>")))


def chunks(items: Column, size: int, least: int) -> Column:
    """Items cut into runs of ``size``, the last if it has ``least`` or more."""
    none = F.array().cast("array<int>")
    cut = lambda x: F.transform(F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(size))).otherwise(none), lambda i: F.slice(x, i + 1, size))
    return F.filter(bind(items, cut), lambda c: F.size(c) >= least)


def drop_reason(text: Column, least_words: int = 50, most_devanagari: float = 0.30) -> Column:
    """Why a document is dropped: the first reason, or an empty text to keep it. A null
    text has no words."""
    text = F.coalesce(text, F.lit(""))
    n, ratio = word_count(text), devanagari_ratio(text)
    few = F.concat(F.lit("words="), n.cast("string"), F.lit(f" below floor ({least_words})"))
    return F.when(n < least_words, few).when(ratio > most_devanagari, F.lit("devanagari ratio above limit")).otherwise(F.lit(""))


def is_cruft(text: Column) -> Column:
    """Whether the text names one of the categories that are no subject matter."""
    some = "|".join(CRUFT)
    return text.rlike(rf"(?i)Categories:[ \t\n]*(\[[^\]]+\]\([^)]+/category/({some})\)|\[({some})\])")
