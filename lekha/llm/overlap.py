"""Same or nearly the same records in evaluation and training splits.

Ids are compared by an equi-join. Texts are compared by an edit-distance segment
join over words: each evaluation text is cut into disjoint segments of two words;
of these, as many of the rarest as edits can touch and one more are looked up in
the training texts, at positions that the edits allow, and what matches is
verified by banded dynamic programming.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.llm.passages import held, words
from lekha.session import broadcast_if_small

#: Share of words that may be changed, moved, dropped or added.
RATE = 0.22
#: Frames of questions don't make a case: of the different words that stand in at
#: most RARE of the evaluation texts, at least KEPT must be shared.
RARE, KEPT = 0.05, 0.5

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>|\\[a-z]+\{|\*\*|~~")
_ASIDE = re.compile(r"[(\[{][^()\[\]{}]{0,60}?(?:\b(?:marks?|mock|words?|paper|set|test|exam|pyq|repeat(?:ed)?|source|year|(?:19|20)\d\d|q(?:uestion)?\s*(?:no)?\.?\s*\d)\b|अंक|शब्द|प्रश्न)[^()\[\]{}]{0,60}?[)\]}]", re.IGNORECASE)
_NUMBER = re.compile(r"(?mi)^\s*(?:q(?:uestion|ues)?|प्रश्न|प्र)?\s*(?:no)?\s*[.:]?\s*[(\[]?\d{1,3}\s*[.):\]-]\s+|^\s*(?:q(?:uestion|ues)?|प्रश्न|प्र)\s*(?:no)?\s*[.:]?\s*\d{1,3}\s*[.):-]?\s+")
_TAIL = re.compile(r"[-–—|,]?\s*\b\d{1,3}\s*marks?\.?\s*$", re.IGNORECASE)


def plain(text: str | None) -> list[str]:
    """Words of a text without tags, numbering and mark counts, in lower case."""
    if not text:
        return []
    t = _TAG.sub(" ", html.unescape(text))
    t = _ASIDE.sub(" ", t)
    return words(_TAIL.sub("", _NUMBER.sub(" ", t.strip())))


def text_of(raw: str | None, fields: tuple[str, ...]) -> str | None:
    """The first of ``fields`` that is a string in a JSON object."""
    if not raw:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    return next((value[f] for f in fields if isinstance(value.get(f), str)), None) if isinstance(value, dict) else None


def allowed(n: int, rate: float = RATE) -> int:
    """Edits that a text of ``n`` words may have."""
    return int(rate * n + 1e-9)


def common_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band``
    of the diagonal: one row at a time, the running maximum taken along it."""
    n, m = len(a), len(b)
    row = np.zeros(m + 1, np.int32)
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        if lo >= hi:
            continue
        new = row[lo : hi + 1].copy()
        np.maximum(new[1:], row[lo:hi] + (b[lo:hi] == a[i]), out=new[1:])
        np.maximum.accumulate(new, out=new)
        row[lo : hi + 1] = new
        row[hi + 1 :] = np.maximum(row[hi + 1 :], new[-1])
    return int(row[m])


class Frequencies:
    """Numbers of the words of the query set, and how many of its texts hold each."""

    def __init__(self, texts: Iterable[list[str]] = ()) -> None:
        self.vocabulary: dict[str, int] = {}
        self.count: list[int] = []
        self.texts = 0
        for ws in texts:
            self.add(ws)

    def add(self, words: list[str]) -> None:
        self.texts += 1
        for w in dict.fromkeys(words):
            at = self.vocabulary.setdefault(w, len(self.count))
            if at == len(self.count):
                self.count.append(0)
            self.count[at] += 1


class Texts:
    """Training texts as numbers of the query set's words, in one array."""

    def __init__(self, texts: list[list[str]], vocabulary: dict[str, int]) -> None:
        get, other = vocabulary.get, len(vocabulary)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.ids = np.full(int(self.first[-1]), other, np.int64)
        for t, at in zip(texts, self.first.tolist(), strict=False):
            self.ids[at : at + len(t)] = [get(w, other) for w in t]
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.ids)) - self.first[self.doc]


class Segments:
    """Segments of a block of evaluation texts, for lookup. ``often`` counts the texts of
    the whole query set that hold each word, so what is rare doesn't depend on blocks."""

    def __init__(self, texts: list[tuple[tuple, list[str]]], rate: float = RATE, often: Frequencies | None = None) -> None:
        self.rate = rate
        # Given to all blocks, the vocabulary isn't sent with each.
        self.vocabulary = None if often else (often := Frequencies(ws for _, ws in texts)).vocabulary
        self.keys = [k for k, _ in texts]
        self.ids = [np.array([often.vocabulary[w] for w in ws], np.int64) for _, ws in texts]
        self.size = len(often.vocabulary) + 1
        self.rare = np.array([*often.count, 0]) <= max(1, RARE * often.texts)
        self.rare[self.size - 1] = False
        own = [np.unique(x[self.rare[x]]) for x in self.ids]
        self.need = np.array([np.ceil(KEPT * len(x)) if len(x) > 3 else 0 for x in own], np.int64)
        word, owner = np.concatenate(own or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(word, kind="stable")
        self.rare_owner, self.rare_begin = owner[order], np.searchsorted(word[order], np.arange(self.size + 1))
        # (width, key) of all segments; texts of under 8 words are cut into single words.
        cuts: list[list[tuple[int, int, int]]] = []
        often: Counter = Counter()
        for x in self.ids:
            width = 1 if len(x) < 8 else 2
            mine = [(width, int(x[i]) if width == 1 else int(x[i]) * self.size + int(x[i + 1]), i) for i in range(0, len(x) - width + 1, width)]
            cuts.append(mine)
            often.update({s[:2] for s in mine})
        tables: dict[int, list[tuple[int, int, int]]] = {1: [], 2: []}
        for e, mine in enumerate(cuts):
            # A changed, dropped or added word touches one segment, a moved word two;
            # half of the edits may be moves. Of a longer training text more edits are allowed.
            n = len(self.ids[e])
            k = allowed(int(n / (1 - rate)) if n else 0, rate)
            for width, key, at in sorted(mine, key=lambda s: (often[s[:2]], s[2]))[: k + k // 2 + 1]:
                tables[width].append((key, e, at))
        self.tables = {}
        for width, rows in tables.items():
            t = np.array(sorted(rows), np.int64).reshape(-1, 3)
            names, begin = np.unique(t[:, 0], return_index=True)
            self.tables[width] = (names, np.append(begin, len(t)), t[:, 1], t[:, 2])

    def matches(self, texts: Texts | list[list[str]]) -> list[tuple[int, int]]:
        """(training text, evaluation text) of all pairs that are nearly the same."""
        texts = Texts(texts, self.vocabulary) if isinstance(texts, list) else texts
        ids, doc, place, first, sizes = texts.ids, texts.doc, texts.place, texts.first, texts.sizes
        lengths = np.array([len(x) for x in self.ids], np.int64)
        found = []
        for width, (names, begin, owner, at) in self.tables.items():
            if not len(names) or len(ids) < width:
                continue
            key = ids if width == 1 else np.where(doc[:-1] == doc[1:], ids[:-1] * self.size + ids[1:], -1)
            where = np.searchsorted(names, key)
            hit = np.flatnonzero(names[np.minimum(where, len(names) - 1)] == key)
            per = begin[where[hit] + 1] - begin[where[hit]]
            p = np.repeat(hit, per)
            entry = np.repeat(begin[where[hit]], per) + np.arange(len(p)) - np.repeat(np.cumsum(per) - per, per)
            e = owner[entry]
            longest = np.maximum(lengths[e], sizes[doc[p]])
            k = (self.rate * longest + 1e-9).astype(np.int64)
            ok = (np.abs(lengths[e] - sizes[doc[p]]) <= k) & (np.abs(at[entry] - place[p]) <= k)
            found.append(np.unique(doc[p[ok]] * len(self.ids) + e[ok]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        # Shared rare words per pair, from the words' lists of evaluation texts.
        seen = np.unique(doc * self.size + ids)
        seen = seen[self.rare[seen % self.size]]
        w = seen % self.size
        per = self.rare_begin[w + 1] - self.rare_begin[w]
        entry = np.repeat(self.rare_begin[w], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        shared, count = np.unique(np.repeat(seen // self.size, per) * len(self.ids) + self.rare_owner[entry], return_counts=True)
        at = np.minimum(np.searchsorted(shared, pairs), max(0, len(shared) - 1))
        have = np.where(shared[at] == pairs, count[at], 0) if len(shared) else np.zeros(len(pairs), np.int64)
        out = []
        for pair in pairs[have >= self.need[pairs % max(1, len(self.ids))]].tolist():
            d, e = divmod(pair, len(self.ids))
            mine, theirs = self.ids[e], ids[first[d] : first[d + 1]]
            longest = max(len(mine), len(theirs))
            k = allowed(longest, self.rate)
            if longest - common_words(mine, theirs, k) <= k:
                out.append((d, e))
        return out


def base_id(key: Column) -> Column:
    """The second of an id's colon-separated parts, ignoring case and blanks; null
    where there is none."""
    part = F.lower(F.regexp_replace(F.try_element_at(F.split(key, ":"), F.lit(2)), r"[\s\x{A0}\x{200B}\x{FEFF}]+", ""))
    return F.when(part != "", part)


QUESTION, ARTICLE = ("question", "question_text"), ("source_text", "article")


def split_texts(splits: DataFrame) -> Iterator[tuple[tuple, list[str], bool]]:
    """((split, id), words, whether it is an article) of collected evaluation rows."""
    for r in splits.collect():
        for fields, article in ((QUESTION, False), (ARTICLE, True)):
            ws = plain(text_of(r.payload, fields))
            if ws:
                yield (r.split, r.question_id), ws, article


def overlaps(splits: DataFrame, training: DataFrame, rate: float = RATE, block_rows: int = 20_000) -> DataFrame:
    """split, question_id and pair_id of every overlap of an evaluation record and
    a training record: the same base id, or nearly the same text.

    ``splits`` has split, question_id and payload (JSON with question,
    question_text or source_text), ``training`` pair_id and input (JSON with
    question, question_text or article). Questions are compared with questions,
    articles with articles. Texts are nearly the same if of the longer one's words
    no more than ``rate`` are out of their longest common subsequence, case,
    spacing, punctuation, numbering, mark counts and tags aside; a word that is
    moved, changed, dropped or added counts once. Half of the words that are rare
    among the evaluation texts must be shared, so a common frame is no case.

    The evaluation records are a stated query set, sent out in blocks of
    ``block_rows``, of which a worker holds one at a time; the training records are
    read once, however many blocks there are. Null ids or texts, JSON that can't be read and ids without a
    second part match nothing; repeated rows give each case once; empty tables an
    empty result; other columns are not carried.
    """
    splits = splits.select("split", "question_id", F.col("payload").cast("string").alias("payload")).filter("question_id IS NOT NULL").distinct()
    training = training.select("pair_id", F.col("input").cast("string").alias("input")).filter("pair_id IS NOT NULL")
    ids = splits.select("split", "question_id", base_id(F.col("question_id")).alias("base")).filter("base IS NOT NULL").distinct()
    out = training.select("pair_id", base_id(F.col("pair_id")).alias("base")).join(broadcast_if_small(ids), "base").select("split", "question_id", "pair_id")
    parts = max(1, -(-splits.count() // block_rows))
    spark = training.sparkSession
    block = lambda k: splits.filter(F.pmod(F.xxhash64("split", "question_id"), F.lit(parts)) == k) if parts > 1 else splits
    often = (Frequencies(), Frequencies())
    for k in range(parts):
        for _, ws, article in split_texts(block(k)):
            often[article].add(ws)
    blocks = []
    for k in range(parts):
        rows = list(split_texts(block(k)))
        blocks.append(spark.sparkContext.broadcast(tuple(Segments([(key, w) for key, w, a in rows if a == article], rate, often[article]) for article in (False, True))))
    known = spark.sparkContext.broadcast(tuple(o.vocabulary for o in often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            ready = []
            for vocabulary, fields in zip(known.value, (QUESTION, ARTICLE), strict=True):
                at: dict[str, list[int]] = {}
                for i, raw in enumerate(raws):
                    t = text_of(raw, fields)
                    if t:
                        at.setdefault(t, []).append(i)
                ready.append((list(at.values()), Texts([plain(t) for t in at], vocabulary)))
            for one in blocks:
                got = sorted({(*segments.keys[e], pairs[i]) for segments, (where, texts) in zip(held(one, len(blocks) > 1), ready, strict=True) for d, e in segments.matches(texts) for i in where[d]})
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.string()) for c in range(3)], names=["split", "question_id", "pair_id"])

    return out.unionByName(training.mapInArrow(run, "split string, question_id string, pair_id string")).distinct()
