"""Scores of answers as Spark columns, and the few that need Python."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lekha.functions.stems import stem
from lekha.functions.text import SPACE, bind, words

#: Markers of reasoning, and those of them that say why or against what.
MARKERS = ("because", "therefore", "hence", "thus", "since", "so that", "as a result", "however", "but", "although", "though", "whereas", "first", "firstly", "second", "secondly", "third", "thirdly", "finally", "if", "then", "else", "otherwise", "in fact", "specifically", "namely", "for example", "for instance", "e.g.", "क्योंकि", "इसलिए", "परंतु", "लेकिन", "यदि", "तब")
CAUSAL = ("because", "therefore", "hence", "thus", "since", "however", "whereas", "although", "क्योंकि", "इसलिए", "परंतु", "लेकिन")

#: What an abstention says, as whole words in English and anywhere in Hindi.
ABSTAINS_EN = ("cannot answer", "can'?t answer", "i\\s+(?:don'?t|do not)\\s+know", "insufficient\\s+(?:information|context)", "unable\\s+to\\s+(?:answer|determine)", "no\\s+answer", "none\\s+of\\s+the\\s+above", "skip(?:ping)?")
ABSTAINS_HI = ("मुझे\\s+(?:नहीं\\s+पता|ज्ञात\\s+नहीं|पता\\s+नहीं)", "उत्तर\\s+(?:नहीं\\s+मालूम|ज्ञात\\s+नहीं)", "जानकारी\\s+(?:अनुपलब्ध|नहीं)", "असमर्थ", "स्किप")

#: Common words that tell no option from another.
COMMON = ("this", "that", "with", "from", "have", "been", "were", "they", "their", "there", "which", "what", "when", "where", "while", "than", "then", "some", "such", "only", "into", "also", "these", "those", "would", "could", "should", "shall", "will", "must", "many", "more", "most", "much", "very", "even", "each", "every", "both", "above", "below", "between", "during", "after", "before", "about")

#: Directive verbs by the depth they ask for.
HIGH_VERBS = ("analyze", "analyse", "evaluate", "critically", "examine", "assess")
LOW_VERBS = ("describe", "list", "outline", "discuss", "comment", "explain")

LETTERS = r"[A-Za-z\x{0900}-\x{097F}]+"
EDGE_L, EDGE_R = "(^|[^A-Za-z0-9_])", "([^A-Za-z0-9_]|$)"
#: What a word boundary lies beside: letters, digits and underscores of any script,
#: but not combining marks, so a word that ends in one is bounded by a letter only.
WORD = r"[\p{L}\p{N}_]"


def word_tokens(text: Column) -> Column:
    """Runs of Latin letters or Devanagari."""
    return F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTERS))


def n_sentences(text: Column) -> Column:
    """Sentences: ends followed by white space and a capital, digit, quote, bracket
    or Devanagari letter, and one; 0 for a blank text."""
    ends = F.regexp_count(text, F.lit(rf"[.!?\x{{0964}}]{SPACE}+[A-Z0-9\"'(\[\x{{0900}}-\x{{097F}}]"))
    return F.when(F.regexp_replace(text, f"{SPACE}+", "") == "", 0).otherwise(ends + 1)


def years(text: Column) -> Column:
    """Different years from 1900 to 2199."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9A-Za-z_])((?:19|20|21)[0-9]{2})(?=[^0-9A-Za-z_]|$)"), F.lit(1))))


def numbers(text: Column) -> Column:
    """Different numbers, with decimals."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))))


def articles(text: Column) -> Column:
    """Numbers of the articles that a text cites."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"Article[ \t\n]+([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def cited_share(text: Column, known: tuple[int, ...]) -> Column:
    """Share of the cited articles that are known ones; 1 where none is cited."""
    return bind(articles(text), lambda x: F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.filter(x, lambda n: n.isin(*known))) / F.size(x)))


def set_f1(a: Column, b: Column, both_empty: float) -> Column:
    """F1 of two sets; ``both_empty`` where neither has members."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(2.0 * common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def repetition(tokens: Column, n: int = 4) -> Column:
    """Share of the n-grams that occur more than once."""
    grams = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, n)))).otherwise(F.array().cast("array<bigint>"))
    sorted_grams = bind(tokens, lambda t: F.array_sort(grams(t)))
    # In sorted order an n-gram repeats if it equals a neighbour.
    return bind(sorted_grams, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(g)), F.lit(0), lambda k, i: k + F.when((F.coalesce(F.get(g, i - 2), g[i - 1] - 1) == g[i - 1]) | (F.coalesce(F.get(g, i), g[i - 1] - 1) == g[i - 1]), 1).otherwise(0)) / F.size(g)))


def moving_ttr(tokens: Column, window: int = 100) -> Column:
    """Mean share of different tokens over all windows; over the whole where shorter."""
    part = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - window + 1), lambda i: F.size(F.array_distinct(F.slice(t, i, window))))
    return bind(tokens, lambda t: F.when(F.size(t) < window, F.size(F.array_distinct(t)) / F.greatest(F.lit(1), F.size(t))).otherwise(bind(part(t), lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x) / (F.size(p) * F.lit(float(window))))))


def length_adherence(actual: Column, target: Column) -> Column:
    """1 within a tenth of the target; a shortfall costs one and a half times its
    share, an excess its share."""
    t = F.greatest(F.lit(1), target)
    gap = actual - t
    return F.when(F.abs(gap) <= 0.10 * t, 1.0).when(gap < 0, F.greatest(F.lit(0.0), 1.0 + 1.5 * gap / t)).otherwise(F.greatest(F.lit(0.0), 1.0 - gap / t))


def count_adherence(actual: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(actual - target) / F.greatest(F.lit(1), target))


def paragraph_adherence(n: Column, target_words: Column) -> Column:
    """1 within the usual number of paragraphs for the length, else less by the
    distance to it."""
    lo = F.when(target_words <= 175, 1).when(target_words <= 400, 3).otherwise(8)
    hi = F.when(target_words <= 175, 2).when(target_words <= 400, 5).otherwise(12)
    gap = F.when(n < lo, lo - n).when(n > hi, n - hi).otherwise(0)
    return F.greatest(F.lit(0.0), 1.0 - gap / hi)


def compression(ratio: Column) -> Column:
    """1 from a fifth to a half, falling in a line to 0 and to 1."""
    return F.when(ratio < 0.2, F.greatest(F.lit(0.0), ratio / 0.2)).when(ratio <= 0.5, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (ratio - 0.5) / 0.5))


def bounded(phrases: tuple[str, ...]) -> str:
    """Pattern of phrases between word boundaries; their own ends are letters, digits
    or marks, and the boundary lies on the other side of what the end is."""
    one = lambda w: re.escape(w) + (f"(?!{WORD})" if w[-1].isalnum() else f"(?={WORD})")
    return f"(?<!{WORD})(?:{'|'.join(map(one, phrases))})"


def markers_per_100(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """Markers of reasoning per hundred words."""
    return 100.0 * F.regexp_count(F.lower(text), F.lit(bounded(markers))) / F.greatest(F.lit(1), n_tokens(text))


def foreign_share(text: Column) -> Column:
    """Share of letters that are not Devanagari; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    own = F.regexp_count(text, F.lit(r"[\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097F}]"))
    return F.when(letters == 0, 0.0).otherwise(1.0 - own / letters)


def abstains(text: Column) -> Column:
    """Whether a response says that it gives no answer."""
    white = lambda ps: "|".join(ps).replace("\\s", SPACE)
    return F.lower(text).rlike(f"(?<!{WORD})(?:{white(ABSTAINS_EN)})(?!{WORD})|{white(ABSTAINS_HI)}")


def directive(text: Column) -> Column:
    """Class of the directive verb, the deeper first."""
    return F.when(F.lower(text).rlike(bounded(HIGH_VERBS)), "high").when(F.lower(text).rlike(bounded(LOW_VERBS)), "low").otherwise("unknown")


def last_integer(text: Column) -> Column:
    """Last whole number of up to three digits, held within 0 and 100."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9A-Za-z_])([0-9]{1,3})(?=[^0-9A-Za-z_]|$)"), F.lit(1))
    return F.least(F.lit(100), F.try_element_at(found, F.lit(-1)).cast("int"))


def first_letter(text: Column) -> Column:
    """First A to D that stands alone."""
    return F.nullif(F.regexp_extract(F.upper(text), rf"{EDGE_L}([ABCD]){EDGE_R}", 2), F.lit(""))


def recovered_json(text: Column) -> Column:
    """A JSON object out of a response: the whole, what a fence holds, or from the
    first brace to the last; null where none can be read."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?[ \t\n]*(\{.*\})[ \t\n]*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(good(F.trim(text)), good(fence), good(braces))


def band(score: Column, most: Column) -> Column:
    share = score / most
    return F.when(share <= 0.30, "low").when(share <= 0.60, "mid").otherwise("high")


def lead(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit by bit."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for w in b:
        u = state & at.get(w, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(cand: pd.Series, ref: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of word stems; 0 where a side is blank.
    Words are runs of ASCII letters and digits; those over three letters are stemmed."""
    known: dict[str, str] = {}

    def stems(t: str | None) -> list[str]:
        out = []
        for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
            if w not in known:
                known[w] = stem(w) if len(w) > 3 else w
            out.append(known[w])
        return out

    def one(c: str | None, r: str | None) -> float:
        a, b = stems(c), stems(r)
        return 2 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0

    return pd.Series([one(c, r) for c, r in zip(cand, ref, strict=True)])


@F.pandas_udf(DoubleType())
def chrf(cand: pd.Series, ref: pd.Series) -> pd.Series:
    """Character and word n-gram F-score (six and two orders, recall twice)."""

    def grams(items: str | list[str], n: int) -> Counter:
        return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))

    def one(c: str | None, r: str | None) -> float:
        if not (c or "").strip() or not (r or "").strip():
            return 0.0
        got = []
        for x, y, most in (("".join(c.split()), "".join(r.split()), 6), (c.split(), r.split(), 2)):
            for n in range(1, most + 1):
                a, b = grams(x, n), grams(y, n)
                if a and b:
                    m = sum((a & b).values())
                    got.append((m / sum(a.values()), m / sum(b.values())))
        p, q = (sum(v) / len(got) for v in zip(*got, strict=True)) if got else (0.0, 0.0)
        return 5 * p * q / (4 * p + q) if p + q else 0.0

    return pd.Series([one(c, r) for c, r in zip(cand, ref, strict=True)])


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade, with syllables counted as runs of vowels; 0 without words."""
    sents = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+([ \t\n\r\f]|\z)")))
    syllables = lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))) - F.when(F.endswith(w, F.lit("e")) & (F.length(w) > 2), 1).otherwise(0)
    return bind(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda ws: F.when(F.size(ws) == 0, 0.0).otherwise(0.39 * F.size(ws) / sents + 11.8 * F.aggregate(ws, F.lit(0), lambda k, w: k + syllables(w)) / F.size(ws) - 15.59))


@F.pandas_udf(StringType())
def flat_json(raw: pd.Series) -> pd.Series:
    """Text of a JSON value of any shape: strings as they are, lists by line, of an
    object its english member or else all members."""

    def flat(v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, dict):
            return flat(v["english"]) if v.get("english") else "\n".join(x for x in map(flat, v.values()) if x)
        if isinstance(v, list):
            return "\n".join(x for x in map(flat, v) if x)
        return str(v)

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return flat(json.loads(t))
        except ValueError:
            return t

    return raw.map(one)


def schedule(step: Column, total: int, warm: float = 0.01, stay: float = 0.80, floor: float = 0.1) -> Column:
    """Learning rate factor that rises in a line from the first step on, stays, and
    falls as half a cosine to ``floor``."""
    up = max(1, round(total * warm))
    down = up + round(total * stay)
    if total <= down:
        return F.when(step < up, (step + 1) / float(up)).when(step < down, F.lit(1.0)).otherwise(F.lit(floor))
    x = F.least(F.lit(1.0), (step - down) / float(total - down))
    return F.when(step < up, (step + 1) / float(up)).when(step < down, F.lit(1.0)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * x)))
