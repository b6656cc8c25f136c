"""Repair of text from scanned pages.

Each file is read once: running lines and page numbers are told from text lines,
and the words of text lines and the breaks at line ends come out. The words of all
files make the vocabulary. Readings of a suspicious word are retrieved by a join on
positional character bigrams, the rarest of each word, and gradient-boosted trees,
fitted to known words that were misread on purpose at the rates that the corpus
shows, choose one or none. Counts are only compared with counts, so a larger corpus
of the same kind gives the same answer. Pairs of lines are judged by two
more such models: whether two lines are one running line, and whether the end of
one line and the start of the next are one word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.boosting import Boosted
from lekha.session import broadcast_if_small, cut, hash_sample

#: Usual misreadings (right, read); what the corpus shows is added.
MISREAD = (("e", "c"), ("i", "l"), ("t", "f"), ("l", "1"), ("s", "5"), ("n", "ri"), ("o", "0"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("g", "9"), ("h", "b"), ("b", "6"), ("li", "h"), ("w", "vv"), ("rn", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("i", "1"), ("b", "8"), ("z", "2"))
#: A right form occurs at least so many times as often as one misread form of it.
TIMES = 2
#: For the fit, a word that may be a misread form is none if it is not so many times rarer.
RARER = 10
#: A reading shares at least this much of the different bigrams of either word.
SHARED = 0.35
#: A misreading that the corpus shows is one of at least this share of the words that
#: differ from a right form in one place.
SHOWN = 0.005
#: The rates of one misreading differ between words by about this much, as a logarithm.
SPREAD = 1.5
#: Files that a task takes apart at a time.
FILES = 64
#: Two lines that differ in a larger share of their letters are not one running line.
APART = 0.25
ODD = "�ﬁﬂﬀﬃﬄﬅﬆ"

_TOKEN = re.compile(rf"[^\W_]*(?:[{ODD}][^\W_]*)+|[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]|�")
_PAIR = re.compile(r"(?=\b([^\W\d_]+-[^\W\d_]+)\b)")
_MARK = re.compile(rf"([^\W_{ODD}]|[{ODD}])([-\u00ac\u00ad\u2010\u2011])\s*$")
#: Marks of a break; an empty end is none.
_MARKS = frozenset("-\u00ac\u00ad\u2010\u2011")
_BREAK = re.compile(r"[\s\x0c]*(?:[-=_*~#—–•·.]\s*){3,}$")
_CAPTION = re.compile(r"\W*(?:table|fig(?:ure)?|box|map|chart|plate|annex(?:ure)?|exhibit)\b\.?\s*[\dIVXLC]", re.IGNORECASE)
_D = r"[0-9OolI|SsBZzGgqbi�]"
_STYLES = {
    "page": re.compile(rf"\W*(?:p\s?a\s?g\s?e|pg|p|पृष्ठ)\s*\.?\s*[-:]?\s*({_D}{{1,4}}|[ivxlc]+)\s*(?:of\s*{_D}{{1,4}})?\W*$", re.IGNORECASE),
    "tail": re.compile(rf"\W*({_D}{{1,4}}|[ivxlc]+)\s*\|\s*p\s*a\s*g\s*e\W*$", re.IGNORECASE),
    "of": re.compile(rf"\W*({_D}{{1,4}})\s*(?:/|of)\s*({_D}{{1,4}})\W*$"),
    "dash": re.compile(rf"\s*[-–—~*·]+\s*({_D}{{1,4}}|[ivxlc]+)\s*[-–—~*·]+\s*$"),
    "box": re.compile(rf"\s*[\[(<{{]\s*({_D}{{1,4}}|[ivxlc]+)\s*[\])>}}]\s*$"),
    "bare": re.compile(rf"\s*({_D}{{1,4}})\s*$"),
    "roman": re.compile(r"\s*([ivxlc1]{1,8})\s*$|\s*([IVXLC]{1,8})\s*$"),
}
_DIGIT = str.maketrans("OolI|SsBZzGgqbi", "001115582269961"[:15])
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


#: More letters and digits than any style of page number has.
_FULL = re.compile(r"(?:[\W_]*[^\W_]){25}")
_NUMBERED = re.compile(rf"^\W*{_D}{{1,4}}\s{{2,}}|\s{{2,}}{_D}{{1,4}}\W*$|^\W*\d{{1,4}}\W+|\W+\d{{1,4}}\W*$")


#: What each way to bear a number has.
_MAYBE_NUMBERED = re.compile(r"\d|\s\s")


def number(text: str, style: str) -> int | None:
    """Value of a page number; none where it can't be read."""
    t = text.strip().lower()
    if style == "roman" or t and set(t) <= set("ivxlc") and not any(c.isdigit() for c in t):
        t = t.replace("1", "l") if set(t) - {"1"} else t
        t = t.replace("l", "i") if set(t) <= set("ilvx") and "l" in t else t
        total = 0
        for a, b in zip(t, [*t[1:], ""], strict=True):
            v = _ROMAN.get(a, 0)
            total += -v if v < _ROMAN.get(b, 0) else v
        return total or None
    t = text.strip().translate(_DIGIT)
    return int(t) if t.isdigit() else None


_ALIKE, _ALSO = str.maketrans("0519682|", "olsgbbzl"), str.maketrans("ctilh", "eflib")


def fold(text: str) -> str:
    """Letters of a line with usual misreadings made one, without digits' places."""
    t = text.lower()
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h")):
        t = t.replace(a, b)
    t = t.translate(_ALIKE).translate(_ALSO).replace("i", "l")
    return t if t.isalpha() else "".join(c for c in t if c.isalpha() or c == "�")


def letters(text: str) -> str:
    """A line without the page number that it begins or ends with."""
    s = text.strip()
    return _NUMBERED.sub("", s) if _MAYBE_NUMBERED.search(s) else s


def distance(a: str, b: str, most: int) -> int:
    """Edit distance up to ``most``, U+FFFD matching any one letter; rows of the
    table within that distance of the diagonal only."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        x, lo, hi = a[i - 1], max(1, i - most), min(m, i + most)
        new = [far] * (m + 1)
        if i <= most:
            new[0] = i
        last = least = new[lo - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = row[j - 1] if x == y or x == "�" or y == "�" else row[j - 1] + 1
            if row[j] < v:
                v = min(v, row[j] + 1)
            if last < v:
                v = min(v, last + 1)
            new[j] = last = v
            if v < least:
                least = v
        if least > most:
            return far
        row = new
    return min(row[m], far)


def same_line_features(a: str, b: str) -> list[float]:
    """Whether two lines of a file may be one running line: features of the pair."""
    x, y = letters(a), letters(b)
    f, g = fold(x), fold(y)
    n = max(len(f), len(g), 1)
    d = distance(f, g, max(2, n // 3))
    return [float(f == g), d / n, float(n), abs(len(x) - len(y)) / n, float(x.isupper() == y.isupper()), float(x[:1].isupper() and y[:1].isupper()), float(len(x.split()) != len(y.split()))]


class Page:
    """Lines of a file, sorted into text, running lines, page numbers and the rest."""

    def __init__(self, text: str, n_pages: int | None) -> None:
        self.rows = text.split("\n")
        self.kinds = ["text"] * len(self.rows)
        self._candidates: list[int] | None = None
        self._words: dict[int, list[str]] = {}
        self._breaks: list[tuple[int, int, str, str, str, bool]] | None = None
        for i, r in enumerate(self.rows):
            s = r.strip(" \t\r\x0c\u00a0\u200b\ufeff")
            if not s:
                self.kinds[i] = "blank"
            elif _BREAK.match(s) and not any(c.isalnum() for c in s):
                self.kinds[i] = "mark"
        self._numbers(n_pages)

    def _numbers(self, n_pages: int | None) -> None:
        found: dict[str, list[tuple[int, int | None]]] = defaultdict(list)
        for i, r in enumerate(self.rows):
            s = r.strip(" \t\r\x0c\u00a0\u200b\ufeff")
            if self.kinds[i] != "text" or len(s) > 24 and _FULL.match(s):
                continue
            for style, rx in _STYLES.items():
                m = rx.match(s)
                if m:
                    value = next(g for g in m.groups() if g is not None)
                    if style in ("bare", "box", "dash") and not any(c.isdigit() for c in value) and not set(value.lower()) <= set("ivxlc"):
                        if len(value) > 3 or "�" not in value and not set(value) <= set("lIOoS|"):
                            continue
                    found[style].append((i, number(value, style)))
                    break
        full = [i for i, k in enumerate(self.kinds) if k == "text"]
        edges = {*full[:2], *full[-2:]}
        plain = len(found["bare"]) + len(found["roman"])
        for style, at in found.items():
            chain = self._chain(at)
            sure = style in ("page", "tail", "of", "dash", "box")
            for k, (i, v) in enumerate(at):
                near = any(0 <= j < len(self.rows) and self.kinds[j] in ("blank", "mark") for j in (i - 1, i + 1))
                alone = len(at) == 1 and plain == 1 and (n_pages or 1) <= 2 and (i in edges or v is not None) and not (v and 1500 <= v <= 2100)
                between = v is None and chain and (k and at[k - 1][0] in chain or k + 1 < len(at) and at[k + 1][0] in chain)
                if i in chain and len(chain) > 1 or sure and (style != "box" or len(at) > 1 or near or i in edges) or alone or between:
                    self.kinds[i] = "page_no"

    @staticmethod
    def _chain(at: list[tuple[int, int | None]]) -> set[int]:
        """Lines of the longest run of numbers that go up by one page or a few."""
        best: list[tuple[int, int]] = []
        for k, (_, v) in enumerate(at):
            here = (1, -1)
            for j in range(k):
                u = at[j][1]
                if u is not None and v is not None and 0 < v - u <= 3:
                    here = max(here, (best[j][0] + 1, j))
            best.append(here)
        if not best:
            return set()
        k = max(range(len(best)), key=lambda x: best[x][0])
        out = set()
        while k >= 0:
            out.add(at[k][0])
            k = best[k][1]
        return out

    def candidates(self) -> list[int]:
        """Lines that may be running lines: not like the middle of a text."""
        if self._candidates is None:
            self._candidates = []
            for i, r in enumerate(self.rows):
                if self.kinds[i] != "text" or r[:1].islower() and not _MAYBE_NUMBERED.search(r):
                    continue
                s = letters(r)
                if len(s) > 2 and s[-1] not in ".;,:!?।-\u00ac\u00ad\u2010" and not s[0].islower() and len(_LETTER.findall(s)) > 0.6 * (len(s) - s.count(" ")) and not _CAPTION.match(s):
                    self._candidates.append(i)
        return [i for i in self._candidates if self.kinds[i] == "text"]

    def running(self, same: Boosted | None) -> None:
        """Mark the lines that recur on pages of the file."""
        groups: dict[str, list[int]] = defaultdict(list)
        for i in self.candidates():
            groups[fold(letters(self.rows[i]))].append(i)
        heads = sorted((k for k in groups if k), key=lambda k: -len(groups[k]))
        owner = {k: k for k in heads}
        # Half the difference of letter counts is a lower bound of the edit distance, so
        # lines that differ in more than APART of their letters are not compared.
        letters_of = np.array([np.bincount(np.frombuffer(k.encode("utf-32-le"), np.uint32) % 32, minlength=32) for k in heads], np.int32).reshape(-1, 32)
        size = np.array([len(k) for k in heads])
        for n, k in enumerate(heads):
            if not n:
                continue
            apart = np.abs(letters_of[:n] - letters_of[n]).sum(1) / 2
            for m in np.flatnonzero(apart <= APART * np.maximum(size[:n], size[n])).tolist():
                other = heads[m]
                # Lines of a text are longer than running lines, and differ.
                if owner[other] != other or len(groups[other]) < 2 and len(k) > 40:
                    continue
                f = same_line_features(self.rows[groups[other][0]], self.rows[groups[k][0]])
                if f[1] <= APART and ((same.probability(np.array([f]))[0] > 0.5) if same else f[1] <= 0.2):
                    owner[k] = other
                    break
        merged: dict[str, list[int]] = defaultdict(list)
        for k in heads:
            merged[owner[k]] += groups[k]
        for at in merged.values():
            if len(at) > 1:
                for i in at:
                    self.kinds[i] = "running"
        self._breaks = None

    def words(self, i: int) -> list[str]:
        if i not in self._words:
            self._words[i] = _TOKEN.findall(self.rows[i].lower())
        return self._words[i]

    def _aside(self, i: int) -> bool:
        """Captions, headings and numbers, which may stand between the parts of a word."""
        if i not in self._asides:
            r = self.rows[i]
            self._asides[i] = i in self._heads or not any(c.islower() or c in ODD for c in r) or bool(_CAPTION.match(r))
        return self._asides[i]

    def breaks(self) -> list[tuple[int, int, str, str, str, bool]]:
        """(line, next text line, left part, right part, mark, whether the right part
        is in lower case) of words that may be broken at a line's end."""
        if self._breaks is not None:
            return self._breaks
        text = [i for i, k in enumerate(self.kinds) if k == "text"]
        self._heads, self._asides = set(self.candidates()), {}
        out = []
        for n, i in enumerate(text[:-1]):
            r = self.rows[i].rstrip()
            if r[-1:] not in _MARKS:
                continue
            m = _MARK.search(r)
            j = next((j for j in text[n + 1 : n + 4] if not self._aside(j)), text[n + 1])
            if m and any(c.isalpha() or c in ODD for c in self.rows[j][:3].strip()):
                left, right = self.words(i), self.words(j)
                if left and right:
                    out.append((i, j, left[-1], right[0], m[2], self.rows[j].lstrip()[:1].islower() or self.rows[j].lstrip()[:1] in ODD))
        self._breaks = out
        return out

    def tokens(self) -> list[tuple[int, str]]:
        """(line, word in lower case) of text lines, parts of broken words aside."""
        broken = self.breaks()
        skip_last, skip_first = {b[0] for b in broken}, {b[1] for b in broken}
        out = []
        for i, k in enumerate(self.kinds):
            if k == "text":
                words = self.words(i)
                words = words[1:] if i in skip_first else words
                words = words[:-1] if i in skip_last else words
                out += [(i, w) for w in words if w.isalpha() or any(c.isalpha() or c in ODD for c in w)]
        return out

    def compounds(self) -> list[str]:
        """Hyphenated words inside text lines, as left-right."""
        return [m.lower() for i, k in enumerate(self.kinds) if k == "text" and "-" in self.rows[i] for m in _PAIR.findall(self.rows[i])]


def fit_same_line(texts: list[tuple[str, int | None]]) -> Boosted:
    """The model of running lines, from a bounded sample of files: lines that recur
    word for word, and copies of them misread on purpose, against pairs of
    different lines of one file."""
    rng = np.random.default_rng(1)
    x, y = [], []
    for text, n in texts:
        page = Page(text, n)
        at = page.candidates()
        groups: dict[str, list[int]] = defaultdict(list)
        for i in at:
            groups[letters(page.rows[i]).lower()].append(i)
        often = [v for v in groups.values() if len(v) > 2]
        for v in often[:3]:
            line = letters(page.rows[v[0]])
            for k in range(3):
                x.append(same_line_features(line, misread_line(line, rng, k)))
                y.append(1)
        for _ in range(6):
            if len(at) > 1:
                i, j = rng.choice(len(at), 2, replace=False)
                a, b = page.rows[at[i]], page.rows[at[j]]
                if distance(fold(letters(a)), fold(letters(b)), 3) > 3:
                    x.append(same_line_features(a, b))
                    y.append(0)
    # A base of made-up pairs, for corpora with too few running lines.
    base = ["Coastal Tariff And Harbour", "RURAL CREDIT REFORM", "Annual report of the council", "PORTS AND MINISTERS", "Valley of the northern river", "Public Granary", "THE FAMINE CODE", "Weavers and settlements", "Border towns in winter", "Market and modest loan"]
    for i, a in enumerate(base):
        for b in base[i + 1 :]:
            x.append(same_line_features(a, b))
            y.append(0)
        for k in range(6):
            x.append(same_line_features(a, misread_line(a, rng, k % 4)))
            y.append(1)
    return Boosted(rounds=25, depth=3).fit(np.array(x), np.array(y))


def misread_line(text: str, rng: np.random.Generator, times: int, table: tuple[tuple[str, str], ...] = MISREAD) -> str:
    """``text`` with so many misreadings put in."""
    for _ in range(times):
        fits = [(m.start(), a, b) for a, b in table for m in re.finditer(re.escape(a), text, re.IGNORECASE)]
        fits += [(i, c, "�") for i, c in enumerate(text) if c.isalpha()][:2]
        if not fits:
            return text
        at, a, b = fits[rng.integers(len(fits))]
        text = text[:at] + (b.upper() if text[at].isupper() and len(text) > 1 and text.isupper() else b) + text[at + len(a) :]
    return text


class Readings:
    """Costs of misreadings, each the logarithm of one over its rate, and the model that
    chooses a reading. ``lost`` is the cost of a letter that became U+FFFD."""

    def __init__(self, costs: dict[tuple[str, str], float], lost: float = 7.0, model: Boosted | None = None) -> None:
        self.costs, self.lost, self.model = costs, lost, model

    def explain(self, right: str, read: str, most: int = 3) -> tuple[float, int] | None:
        """Least cost and number of misreadings that make ``read`` of ``right``."""
        n, m = len(right), len(read)
        p = 0
        while p < min(n, m) and right[p] == read[p]:
            p += 1
        p = max(0, p - 2)
        right, read = right[p:], read[p:]
        n, m = len(right), len(read)
        best: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}
        for j in range(m + 1):
            for i in range(n + 1):
                here = best.get((i, j))
                if here is None or here[1] > most:
                    continue
                if i < n and j < m and right[i] == read[j]:
                    self._put(best, (i + 1, j + 1), here)
                if i < n and j < m and read[j] == "�":
                    self._put(best, (i + 1, j + 1), (here[0] + self.lost, here[1] + 1))
                for (a, b), v in self.costs.items():
                    if right.startswith(a, i) and read.startswith(b, j):
                        self._put(best, (i + len(a), j + len(b)), (here[0] + v, here[1] + 1))
        return best.get((n, m))

    @staticmethod
    def _put(best: dict, at: tuple[int, int], value: tuple[float, int]) -> None:
        if at not in best or value < best[at]:
            best[at] = value

    def features(self, read: str, right: str, n_read: int, n_right: int) -> list[float] | None:
        """Features of a reading; none where ``right`` can't be read as ``read``."""
        how = self.explain(right, read)
        if how is None or not how[1]:
            return None
        shared, least = shared_grams(read, right)
        if shared < least:
            return None
        odd = sum(c in ODD or c.isdigit() for c in read)
        ratio = math.log(n_read / n_right)
        # The last: how often the form occurs against how often it would be made of the right one.
        return [how[0], float(how[1]), math.log(n_right), ratio, float(len(right)), shared / (len(read) + 1), float(odd), float(len(read) - len(right)), ratio + how[0]]


def differing(a: str, b: str) -> tuple[str, str]:
    """What two words are between the letters that they begin and end with alike."""
    p, most = 0, min(len(a), len(b))
    while p < most and a[p] == b[p]:
        p += 1
    q = 0
    while q < most - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return a[p : len(a) - q], b[p : len(b) - q]


def shared_grams(read: str, right: str) -> tuple[int, int]:
    """Different bigrams, edges included, that two words share within two places, and
    how many they must share at least."""
    a, b = (defaultdict(list), defaultdict(list))
    for w, at in ((f"^{read}$", a), (f"^{right}$", b)):
        for i in range(len(w) - 1):
            at[w[i : i + 2]].append(i)
    shared = sum(any(abs(i - j) <= 2 for i in at for j in b.get(g, ())) for g, at in a.items())
    return shared, math.ceil(SHARED * max(len(a), len(b)))


def fit_readings(words: list[tuple[str, int]], costs: dict[tuple[str, str], float], lost: float) -> Readings:
    """The model of readings, fitted to a bounded sample of the vocabulary (word,
    count): words misread on purpose, as often as the rates say, are to be read as
    themselves and as no other. Words as they stand, rarer than they are too, are no
    misreadings, nor are made-up words that look like one and occur as often as some
    word of the sample."""
    readings = Readings(costs, lost)
    rng = np.random.default_rng(2)
    index: dict[tuple[str, int], list[int]] = defaultdict(list)
    for k, (w, _) in enumerate(words):
        for g in {(f"^{w}$"[i : i + 2], i + d) for i in range(len(w) + 1) for d in (-1, 0, 1)}:
            index[g].append(k)
    x, y = [], []
    table = list(costs)

    def candidates(read: str) -> list[int]:
        found: Counter = Counter()
        for i in range(len(read) + 1):
            found.update(index.get((f"^{read}$"[i : i + 2], i), ()))
        return [k for k, v in found.most_common(60) if v >= SHARED * (len(read) + 1) and abs(len(words[k][0]) - len(read)) <= 2]

    def show(read: str, own: int, n: int) -> None:
        for c in candidates(read):
            if words[c][0] != read and words[c][1] >= TIMES * n and (f := readings.features(read, words[c][0], n, words[c][1])):
                x.append(f)
                y.append(float(c == own))

    def misread(w: str, times: int) -> tuple[str, float]:
        """A word misread so many times, more often in the usual ways, and the cost."""
        total = 0.0
        for _ in range(times):
            fits = [(m.start(), a, b, costs[a, b]) for a, b in table for m in re.finditer(re.escape(a), w)] + [(i, c, "�", lost) for i, c in enumerate(w)]
            weight = np.exp(-np.array([f[3] for f in fits]) / 2)
            at, a, b, cost = fits[rng.choice(len(fits), p=weight / weight.sum())]
            w, total = w[:at] + b + w[at + len(a) :], total + cost
        return w, total

    # Right words are those that are no rare form of a word that they can be read as. A
    # small vocabulary is gone through several times.
    right = [k for k, (w, n) in enumerate(words) if len(w) > 1 and not any(words[c][1] >= RARER * n and readings.features(w, words[c][0], n, words[c][1]) for c in candidates(w))]
    for k in right * max(1, 1000 // max(1, len(right))):
        w, n = words[k]
        for times in (1, 1, 1, 1, 2, 2):
            read, cost = misread(w, times)
            if read != w:
                show(read, k, max(1, int(rng.poisson(min(n / TIMES, n * math.exp(SPREAD * rng.standard_normal() - cost))))))
        show(w, -1, n)
        show(w, -1, max(1, int(n ** rng.random())))
        read, _ = misread(w, 1)
        if rng.random() < 0.4 and read != w:
            show(read, -1, words[right[int(rng.integers(len(right)))]][1])
    if len(set(y)) > 1:
        readings.model = Boosted(rounds=60, depth=4).fit(np.array(x), np.array(y))
    return readings


def fit_joins(words: dict[str, int], pairs: dict[str, int]) -> Boosted:
    """The model of breaks, from known words that are cut in two and compounds that
    are broken at their hyphen."""
    rng = np.random.default_rng(3)
    x, y = [], []
    for w in words:
        if len(w) > 4:
            at = int(rng.integers(2, len(w) - 1))
            for soft in (0, 1):
                x.append(join_features(w[:at], w[at:], words.get(w[:at], 0), words.get(w[at:], 0), words[w] if rng.random() > 0.2 else 0, pairs.get(f"{w[:at]}-{w[at:]}", 0), bool(soft), True))
                y.append(1)
    for c, n in pairs.items():
        a, b = c.split("-", 1)
        x.append(join_features(a, b, words.get(a, 0), words.get(b, 0), words.get(a + b, 0), n if rng.random() > 0.2 else 0, False, True))
        y.append(0)
    x += [join_features("tari", "ff", 0, 0, 9, 0, s, True) for s in (False, True)] * 3 + [join_features("long", "term", 20, 20, 0, 9, False, True)] * 6
    y += [1] * 6 + [0] * 6
    return Boosted(rounds=30, depth=3).fit(np.array(x, float), np.array(y))


def join_features(left: str, right: str, n_left: int, n_right: int, n_joined: int, n_pair: int, soft: bool, lower: bool) -> list[float]:
    return [math.log1p(n_joined), math.log1p(n_pair), math.log1p(n_left), math.log1p(n_right), float(soft), float(lower), float(min(len(left), len(right))), math.log((n_joined + 0.5) / (n_pair + 0.5))]


class Scans:
    """What is found in the files: tables with lineage cut, and their models."""

    def __init__(self, files: DataFrame, key: str = "file_id", text: str = "md_text", pages: str = "n_pages", sample: int = 300) -> None:
        spark = files.sparkSession
        self.key = key
        src = files.select(F.col(key).alias("file_id"), F.col(text).cast("string").alias("text"), F.col(pages).cast("int").alias("n_pages")).filter("text IS NOT NULL AND file_id IS NOT NULL")
        self.kind = src.schema[0].dataType.simpleString()
        some = sorted((r.text, r.n_pages or 0) for r in hash_sample(src, ["file_id"], sample).collect())
        same = spark.sparkContext.broadcast(fit_same_line(some))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                # A few files at a time: what is taken out of a file is larger than the file.
                for at in range(0, whole.num_rows, FILES):
                    b = whole.slice(at, FILES)
                    out: list[tuple] = []
                    for text, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                        page = Page(text, n)
                        page.running(same.value)
                        lines = [{"line_no": i, "kind": k} for i, k in enumerate(page.kinds) if k in ("running", "page_no")]
                        breaks = [dict(zip(("line_no", "next_line", "l", "r", "mark", "low"), x, strict=True)) for x in page.breaks()]
                        words = page.tokens()
                        out.append((lines, breaks, [i for i, _ in words], [w for _, w in words], page.compounds()))
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[c] for r in out], t) for c, t in enumerate(types)]], names=["file_id", "lines", "breaks", "at", "words", "compounds"])

        fields = "lines array<struct<line_no:int,kind:string>>, breaks array<struct<line_no:int,next_line:int,l:string,r:string,mark:string,low:boolean>>, at array<int>, words array<string>, compounds array<string>"
        types = list(spark.createDataFrame([], fields).toArrow().schema.types)
        self.pages = cut(src.mapInArrow(read, f"file_id {self.kind}, {fields}"))
        words = self.pages.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        self.vocabulary = cut(words)
        self.compounds = cut(self.pages.select(F.explode("compounds").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        self._readings()

    def _often(self, words: DataFrame, sample: int) -> list[tuple[str, int]]:
        """About ``sample`` words (word, n) at most, each the more likely the more often
        it occurs; the share of misread forms is that which they have of the text."""
        total = words.agg(F.sum("n")).first()[0] or 1
        bound = F.col("n") * (sample / total * (1 << 40))
        return sorted((r.word, r.n) for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < bound).select("word", "n").collect())

    def _pairs(self, read: DataFrame, right: DataFrame) -> DataFrame:
        """word, n, right, n_right of words that may be a misread form and its reading:
        they share enough bigrams, and the reading is TIMES as frequent or more.

        Words that share so many of their different bigrams share one of the rarest of
        each, so only these are joined and the lists of frequent bigrams are not.
        """
        word = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        places = F.sequence(F.lit(1), F.length("word") + 1)
        every = lambda df: df.withColumn("g", F.array_distinct(F.transform(places, lambda i: F.substr(word, i, F.lit(2)))))
        often = broadcast_if_small(cut(every(right).select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("often"))))

        def rarest(df: DataFrame) -> DataFrame:
            one = every(df).select("word", "n", F.explode("g").alias("g")).join(often, "g", "left").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g"))).alias("g"))
            size = F.size("g")
            first = F.slice("g", F.lit(1), size - F.ceil(size * SHARED).cast("int") + 1)
            return one.select("word", "n", F.explode(first).alias("x")).select("word", "n", F.col("x.g").alias("g")).select("word", "n", "g", F.explode(F.filter(places, lambda i: F.substr(word, i, F.lit(2)) == F.col("g"))).alias("at"))

        a = rarest(read)
        b = rarest(right).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "g", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias("at"))
        close = (F.col("n_right") >= TIMES * F.col("n")) & (F.abs(F.length("word") - F.length("right")) <= 2) & (F.col("word") != F.col("right"))
        return a.join(b, ["g", "at"]).filter(close).select("word", "n", "right", "n_right").distinct()

    def _readings(self, sample: int = 3000) -> None:
        """Corrections (word, right) of misread words of the vocabulary."""
        # Words that are broken at a line's end are read whole.
        broken = self.pages.select(F.explode("breaks").alias("b")).select(F.concat("b.l", "b.r").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        v = self.vocabulary.unionByName(broken.join(self.vocabulary.select("word"), "word", "left_anti")).filter(F.length("word") >= 2)
        right = self.vocabulary.filter(F.length("word") >= 2).filter(F.col("word").rlike(r"^\p{L}[\p{L}\p{M}]+$"))
        # Suspicious: anything but numbers, and with letters in the main.
        read = v.filter(F.regexp_count("word", F.lit(r"\p{L}|[�]")) * 2 >= F.length("word"))
        # Small in bytes but dear to judge, so all tasks share them.
        parts = 2 * self.vocabulary.sparkSession.sparkContext.defaultParallelism
        pairs = cut(self._pairs(read, right).repartition(parts, "word"))
        costs, lost = self._costs(pairs)
        readings = self.vocabulary.sparkSession.sparkContext.broadcast(fit_readings(self._often(right, sample), costs, lost))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                got = [(r, f) for r in rows if (f := readings.value.features(r[0], r[1], r[2], r[3]))]
                model = readings.value.model
                p = model.probability(np.array([f for _, f in got])) if got and model else np.zeros(len(got))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r, _ in got], pa.string()), pa.array([r[1] for r, _ in got], pa.string()), pa.array(p, pa.float64())], names=["word", "right", "p"])

        scored = cut(pairs.select("word", "right", "n", "n_right").mapInArrow(choose, "word string, right string, p double").filter("p >= 0.5"))
        # A reading that is misread itself stands for what it is read as.
        wrong = scored.select(F.col("word").alias("right")).distinct()
        marked = scored.join(wrong.withColumn("wrong", F.lit(True)), "right", "left")
        best = cut(marked.groupBy("word").agg(F.max_by("right", F.struct(F.col("wrong").isNull(), "p", "right")).alias("right")))
        again = best.select(F.col("word").alias("right"), F.col("right").alias("then"))
        self.corrections = cut(best.join(again, "right", "left").select("word", F.coalesce("then", "right").alias("right")))

    def _costs(self, pairs: DataFrame) -> tuple[dict[tuple[str, str], float], float]:
        """Costs of misreadings, the usual ones and those that the corpus shows in many
        words, and of lost letters: how often each occurs against how often it could
        (counts of letters, not words, come to the driver)."""
        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(r, n, *d) for w, r, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if 1 <= len((d := differing(r, w))[0]) <= 3 and 1 <= len(d[1]) <= 2 and "�" not in d[1]]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["right", "n", "a", "b"])

        x = pairs.filter(F.col("n_right") >= 20 * F.col("n")).select("word", "right", "n").mapInArrow(apart, "right string, n bigint, a string, b string")
        x = cut(x.groupBy("a", "b").agg(F.countDistinct("right").alias("n"), F.sum("n").alias("times")))
        every = x.agg(F.sum("n")).first()[0] or 0
        usual = F.concat("a", F.lit(">"), "b").isin([f"{a}>{b}" for a, b in MISREAD])
        # At most one over SHOWN pairs have such a share, so what comes here is bounded.
        seen = {(s.a, s.b): s for s in x.filter(usual | (F.col("n") >= SHOWN * every)).collect()}
        total = sum(s.n for s in seen.values()) + len(MISREAD)
        # Letters that differ between words of one pattern are no misreadings: these have look-alikes on one side or make a large share.
        shown = [k for k, s in seen.items() if k not in MISREAD and (any(c.isdigit() or c in ODD for c in k[1]) or s.n * 20 > total)]
        long = self.vocabulary.filter(F.col("word").rlike(r"^\p{L}[\p{L}\p{M}]+$"))
        table = [*MISREAD, *shown]
        could = long.agg(*[F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(a), F.lit("")))) / len(a)).alias(f"c{k}") for k, (a, _) in enumerate(table)], F.sum(F.col("n") * F.length("word"))).first()
        gone = self.vocabulary.agg(F.sum(F.col("n") * F.regexp_count("word", F.lit("�")))).first()[0] or 0
        # Few occurrences weigh less than a thousand places with two misreadings.
        rate = lambda times, places: min(0.5, (times + 2) / ((places or 0) + 1000))
        costs = {k: -math.log(rate(seen[k].times if k in seen else 0, could[i])) for i, k in enumerate(table)}
        return costs, -math.log(rate(gone, could[len(table)]))

    def misread(self) -> DataFrame:
        """file_id, line_no, word and right of misread words in text lines. Words with
        a replacement character or ligature sign, and words with a digit between
        letters, are misread even if no reading is found (right is null)."""
        at = self.pages.select("file_id", F.posexplode("words").alias("k", "word"), "at").select("file_id", F.col("at")[F.col("k")].alias("line_no"), "word")
        odd = F.col("word").rlike("[�ﬁﬂﬀﬃﬄﬅﬆ]") | F.col("word").rlike(r"^\p{L}*(\p{L}{2}[0156899]\p{L}|\p{L}[0156899]\p{L}{2})\p{L}*$")
        one = at.join(broadcast_if_small(self.corrections), "word", "left").filter(F.col("right").isNotNull() | odd)
        return one.select("file_id", "line_no", "word", "right")

    def joins(self, sample: int = 3000) -> DataFrame:
        """file_id, line_no, next_line, l, r, joined and whether it is one word, of all
        words that may be broken at a line's end."""
        b = self.pages.select("file_id", F.explode("breaks").alias("b")).select("file_id", "b.*")
        counts = self.vocabulary.unionByName(self.compounds).groupBy("word").agg(F.sum("n").alias("n"))
        # A misread form counts as often as its reading.
        fixed = counts.join(self.corrections, "word", "full").join(counts.select(F.col("word").alias("right"), F.col("n").alias("m")), "right", "left").select("word", F.coalesce("m", "n").alias("n"))
        keys = F.array(F.col("l"), F.col("r"), F.concat("l", "r"), F.concat("l", F.lit("-"), "r"))
        asked = b.select("l", "r").distinct().select("l", "r", F.posexplode(keys).alias("role", "word"))
        known = asked.join(broadcast_if_small(fixed), "word", "left").groupBy("l", "r").agg(*[F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(("n_l", "n_r", "n_joined", "n_pair"))])
        words = {w: n for w, n in self._often(self.vocabulary, sample) if w.isalpha()}
        pairs = dict(self._often(self.compounds, sample))
        for c in pairs:
            for part in c.split("-", 1):
                words.setdefault(part, 5)
        model = self.pages.sparkSession.sparkContext.broadcast(fit_joins(words, pairs))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                rows = x.to_pylist()
                f = np.array([join_features(r["l"], r["r"], r["n_l"], r["n_r"], r["n_joined"], r["n_pair"], r["mark"] in "\u00ac\u00ad", r["low"]) for r in rows], float)
                p = model.value.probability(f) if len(rows) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(p >= 0.5)], names=["file_id", "line_no", "next_line", "l", "r", "one"])

        ready = b.join(broadcast_if_small(known), ["l", "r"]).select("file_id", "line_no", "next_line", "l", "r", "mark", "low", "n_l", "n_r", "n_joined", "n_pair")
        return ready.mapInArrow(judge, f"file_id {self.kind}, line_no int, next_line int, l string, r string, one boolean")

    def found(self) -> DataFrame:
        """file_id, line_no and kind of every mark of scanning."""
        lines = self.pages.select("file_id", F.explode("lines").alias("x")).select("file_id", "x.line_no", "x.kind")
        joins = cut(self.joins())
        one = joins.filter("one")
        hyphen = one.select("file_id", "line_no", F.lit("hyphen").alias("kind"))
        # Parts of a broken word: the whole is looked up, and the wrong letter put into its part.
        whole = one.withColumn("word", F.concat("l", "r")).join(broadcast_if_small(self.corrections), "word", "left")
        odd = lambda c: F.col(c).rlike("[�ﬁﬂﬀﬃﬄﬅﬆ]|[0-9]")
        left_wrong = F.coalesce(~F.startswith("right", "l"), odd("l"))
        right_wrong = F.coalesce(~F.endswith("right", "r"), odd("r"))
        parts = whole.filter(F.col("right").isNotNull() | odd("l") | odd("r"))
        apart = joins.filter("NOT one").select("file_id", F.explode(F.array(F.struct("line_no", F.col("l").alias("word")), F.struct(F.col("next_line").alias("line_no"), F.col("r").alias("word")))).alias("x")).select("file_id", "x.line_no", "x.word")
        apart = apart.join(broadcast_if_small(self.corrections), "word", "left").filter(F.col("right").isNotNull() | odd("word")).select("file_id", "line_no")
        wrong = self.misread().select("file_id", "line_no").unionByName(parts.filter(left_wrong).select("file_id", "line_no")).unionByName(parts.filter(right_wrong).select("file_id", F.col("next_line").alias("line_no"))).unionByName(apart)
        return lines.unionByName(hyphen).unionByName(wrong.withColumn("kind", F.lit("misread"))).distinct().withColumnRenamed("file_id", self.key)


    def fixes(self) -> DataFrame:
        """file_id, line_no, word and right of every word to be replaced, and the same
        of joined words (next_line set, word the left part, right the whole)."""
        none = F.lit(None).cast("int")
        single = self.misread().filter("right IS NOT NULL").select("file_id", "line_no", none.alias("next_line"), "word", F.lit("").alias("rest"), "right")
        one = self.joins().filter("one").withColumn("whole", F.concat("l", "r")).join(broadcast_if_small(self.corrections.withColumnRenamed("word", "whole")), "whole", "left")
        return single.unionByName(one.select("file_id", "line_no", "next_line", F.col("l").alias("word"), F.col("r").alias("rest"), F.coalesce("right", "whole").alias("right")))


def rebuilt(text: str, kinds: dict[int, str], fixes: list[dict]) -> list[str]:
    """Paragraphs of a file: text lines joined, what belongs to the page left out,
    broken words put together and misread ones replaced in their case.

    A blank line ends a paragraph, unless it stands at a page's edge in the middle of
    a sentence. Captions and headings are paragraphs of their own.
    """
    rows = text.split("\n")
    replace: dict[int, dict[str, str]] = defaultdict(dict)
    joins: dict[int, dict] = {}
    for f in fixes:
        if f["next_line"] is None:
            replace[f["line_no"]][f["word"]] = f["right"]
        else:
            joins[f["line_no"]] = f
    page = Page(text, None)
    full = sorted(len(r.strip()) for i, r in enumerate(rows) if page.kinds[i] == "text" and kinds.get(i) is None)
    usual = full[len(full) // 2] if full else 0
    # Headings, captions and numbers: short lines that end no sentence.
    aside = {i for i, r in enumerate(rows) if kinds.get(i) is None and len(r.strip()) < 0.6 * usual and (_CAPTION.match(r) or not any(c.isalpha() for c in r))}
    aside |= {i for i in page.candidates() if kinds.get(i) is None and len(rows[i].strip()) < 0.6 * usual}

    def cased(old: str, new: str) -> str:
        return new.upper() if len(old) > 1 and old.isupper() else new[:1].upper() + new[1:] if old[:1].isupper() else new

    def line(i: int, skip: int) -> str:
        out = _TOKEN.sub(lambda m: cased(m[0], replace[i][m[0].lower()]) if m[0].lower() in replace[i] else m[0], rows[i].strip(" \t\r\x0c"))
        return out[skip:].lstrip(" ") if skip else out

    paragraphs: list[str] = []
    current, edge, skips = "", False, {}
    for i, r in enumerate(rows):
        kind = kinds.get(i) or page.kinds[i]
        if kind in ("running", "page_no", "mark") or "\x0c" in r and not r.strip(" \t\r\x0c"):
            edge = True
            continue
        if not r.strip():
            if current and not edge and current[-1:] in ".!?:;।\"'”’)":
                paragraphs.append(current)
                current = ""
            continue
        t = line(i, skips.get(i, 0))
        if i in aside and not (current and current[-1:].isalpha() and t[:1].islower()) and not any(j["next_line"] == i for j in joins.values()):
            # In the middle of a sentence it stands before the paragraph that it interrupts.
            if current and current[-1:] in ".!?:;।":
                paragraphs.append(current)
                current = ""
            paragraphs.append(t)
            continue
        if i in joins:
            j = joins[i]
            m = re.search(rf"({re.escape(j['word'])})\W*$", t, re.IGNORECASE)
            if m:
                t = t[: m.start()] + cased(m[1], j["right"])
                skips[j["next_line"]] = len(j["rest"])
        glue = "" if current.endswith("-") and len(current) > 1 and current[-2].isalpha() or t[:1] in ".,;:!?)" else " "
        current = f"{current}{glue}{t}" if current else t
        edge = False
    if current:
        paragraphs.append(current)
    return [" ".join(p.split()) for p in paragraphs if p.strip()]


def repaired(files: DataFrame, key: str = "file_id", text: str = "md_text", pages: str = "n_pages") -> DataFrame:
    """``key``, para_no and paragraph: the continuous text of every file.

    A file's marks come together with it by its key; all of them belong to one file,
    so a group is as large as a file. Null texts give no paragraphs; of several texts
    of one key the first by content is repaired.
    """
    scans = Scans(files, key, text, pages)
    lines = scans.pages.groupBy("file_id").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    fixes = scans.fixes().groupBy("file_id").agg(F.collect_list(F.struct("line_no", "next_line", "word", "rest", "right")).alias("fixes"))
    src = files.select(F.col(key).alias("file_id"), F.col(text).cast("string").alias("text")).filter("file_id IS NOT NULL AND text IS NOT NULL").groupBy("file_id").agg(F.min("text").alias("text"))
    whole = src.join(lines, "file_id").join(fixes, "file_id", "left").select("file_id", "text", "lines", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(at, FILES) for w in batches for at in range(0, w.num_rows, FILES)):
            out = [(k, n, p) for k, t, ls, fs in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, p in enumerate(rebuilt(t, {x["line_no"]: x["kind"] for x in ls or []}, fs or []))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["file_id", "para_no", "paragraph"])

    return whole.mapInArrow(run, f"file_id {scans.kind}, para_no int, paragraph string").withColumnRenamed("file_id", key)


def scan_marks(files: DataFrame, key: str = "file_id", text: str = "md_text", pages: str = "n_pages") -> DataFrame:
    """``key``, line_no (from 0) and kind (hyphen, misread, running, page_no) of the
    marks of scanning in every file.

    Null texts and null keys give no rows; empty texts have no marks; null or zero
    page counts are unknown. Repeated rows give each case once, several texts of one
    key their union. An empty table gives an empty result; other columns are not
    carried. Whole texts are read.
    """
    return Scans(files, key, text, pages).found()
