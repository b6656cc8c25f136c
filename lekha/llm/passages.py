"""Evaluation texts that leak into training text: a positional inverted index.

The index is cut by document: each Arrow batch of training documents gets its own
postings, for every term the sorted positions at which it stands. They are made
once, where the documents are read, and never shuffled. The query set (passages of
the evaluation texts) goes out once to all executors, in blocks of bounded size; all
blocks are run against a part, one after the other, before the next part is read. A window of query words is looked up
by its two rarest terms: their lists, each shifted by the term's offset in the
window, are intersected, and what is left is compared word by word.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _word_class() -> str:
    """Letters, combining marks and decimal digits as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        yes = c <= sys.maxunicode and (unicodedata.category(chr(c))[0] in "LM" or unicodedata.category(chr(c)) == "Nd")
        if yes and start is None:
            start = c
        elif not yes and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_RUN: list = []
_ASCII = re.compile("[a-z0-9]+").findall


def words(text: str | None) -> list[str]:
    """Longest runs of letters, combining marks and digits, lower-cased."""
    if not _RUN:
        _RUN.append(re.compile(f"[{_word_class()}]+").findall)
    if not text:
        return []
    text = text.lower()
    return _ASCII(text) if text.isascii() else _RUN[0](text)


def strings(value: object) -> Iterator[str]:
    """All string values of a JSON value, nested ones included."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def payload(raw: str | None) -> tuple[list[str], str | None]:
    """String values of a JSON payload, and its question; a payload that is no JSON
    is one string."""
    if not raw:
        return [], None
    try:
        value = json.loads(raw)
    except ValueError:
        return [raw], None
    question = value.get("question") if isinstance(value, dict) else None
    return list(strings(value)), question if isinstance(question, str) else None


class Passages:
    """Queries: all words in one array, as numbers of a vocabulary that all blocks of the
    query set share, and the windows to look up.

    ``size`` words in a row of one value make a case, or all words of a question
    of ``least`` words or more that is shorter than that. Windows begin at every
    ``stride``-th word of a value.
    """

    def __init__(self, rows: list[tuple[object, str | None]], vocabulary: dict[str, int], size: int = 15, least: int = 8, stride: int = 1) -> None:
        """New words of ``rows`` are added to ``vocabulary``."""
        self.size, self.keys = size, []
        text, starts, lengths, owner = [], [], [], []
        seen: set = set()
        for key, raw in rows:
            values, question = payload(raw)
            for value, short in [*((v, False) for v in values), (question, True)]:
                ws = words(value)
                if short and not least <= len(ws) < size or not short and len(ws) < size:
                    continue
                ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in ws)
                if (key, ids) in seen:
                    continue
                seen.add((key, ids))
                span = len(ids) if short else size
                first = len(text)
                text += ids
                at = range(first, first + len(ids) - span + 1, stride)
                starts += at
                lengths += [span] * len(at)
                owner += [len(self.keys)] * len(at)
                self.keys.append(key)
        self.text = np.array(text, np.int32)
        self.starts, self.lengths, self.owner = np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)

    def __len__(self) -> int:
        return len(self.starts)


class Index:
    """Postings of a batch of texts over the query set's vocabulary."""

    def __init__(self, texts: list[str | None], vocabulary: dict[str, int]) -> None:
        get = vocabulary.get
        # Only the numbers of a text's words are kept, not the words.
        rows = [np.array([get(w, -1) for w in words(t)], np.int32) for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        # One place between texts, which no term holds, ends every phrase.
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.text = np.full(int(self.first[-1]) + 64, -1, np.int32)
        for r, at in zip(rows, self.first.tolist(), strict=False):
            self.text[at : at + len(r)] = r
        n = len(vocabulary)
        at = np.flatnonzero(self.text >= 0)
        terms = self.text[at]
        order = np.argsort(terms, kind="stable")
        self.positions = at[order]
        self.count = np.bincount(terms, minlength=n)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.begin[term + 1]]

    def phrases(self, query: Passages) -> tuple[np.ndarray, np.ndarray]:
        """(text, owner) of every exact occurrence of a window."""
        none = np.zeros(0, np.int64)
        if not len(query) or not len(self.positions):
            return none, none
        count = self.count[query.text]
        alive = np.ones(len(query), bool)
        first, second = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for span in np.unique(query.lengths):
            mine = np.flatnonzero(query.lengths == span)
            at = query.starts[mine]
            rare = np.full(len(mine), np.iinfo(np.int64).max)
            rare2, where, where2 = rare.copy(), at.copy(), at.copy()
            for k in range(int(span)):
                c = count[at + k]
                new = c < rare
                again = ~new & (c < rare2) & (query.text[at + k] != query.text[where])
                rare2 = np.where(new, rare, np.where(again, c, rare2))
                where2 = np.where(new, where, np.where(again, at + k, where2))
                rare, where = np.where(new, c, rare), np.where(new, at + k, where)
            alive[mine] = rare > 0
            first[mine], second[mine] = where, where2
        todo = np.flatnonzero(alive)
        if not len(todo):
            return none, none
        # Windows that share both places are looked up once.
        pair = first[todo] * len(query.text) + second[todo]
        pairs, group = np.unique(pair, return_inverse=True)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(pairs) + 1))
        hits_p, hits_w = [], []
        for g, p in enumerate(pairs.tolist()):
            a, b = divmod(p, len(query.text))
            base = self.postings(query.text[a])
            if a != b:
                other = self.postings(query.text[b])
                shifted = base + (b - a)
                at = np.searchsorted(other, shifted)
                base = base[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == shifted)] if len(other) else base[:0]
            if len(base):
                w = todo[order[bounds[g] : bounds[g + 1]]]
                hits_p.append((base[:, None] - (a - query.starts[w])[None]).ravel())
                hits_w.append(np.tile(w, len(base)))
        if not hits_p:
            return none, none
        p, w = np.concatenate(hits_p), np.concatenate(hits_w)
        # What the two rarest lists leave is compared word by word.
        for k in range(int(query.lengths.max())):
            inside = query.lengths[w] > k
            at = p + k
            ok = (at >= 0) & (at < len(self.text))
            ok[ok] = self.text[at[ok]] == query.text[query.starts[w[ok]] + np.minimum(k, query.lengths[w[ok]] - 1)]
            keep = ok | ~inside
            p, w = p[keep], w[keep]
        return np.searchsorted(self.first, p, side="right") - 1, query.owner[w]

    def near(self, query: Passages, slack: int, share: float, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(text, owner) of proximity matches: places of a window in a text at which one
        of its words stands exactly and at least ``share`` of them within ``slack``
        places. Work is cut into steps of about ``pairs`` places."""
        none = np.zeros(0, np.int64)
        if not len(query) or not len(self.positions):
            return none, none
        edge = int(query.lengths.max()) + 2 * slack
        text = np.pad(self.text, edge, constant_values=-1)
        # One bit of 64 for each word that stands within twice the slack of a place: a
        # word that is not there is mostly seen by one look.
        bit = np.where(text >= 0, np.uint64(1) << (text % 64).astype(np.uint64), np.uint64(0))
        around = bit.copy()
        for d in range(1, 2 * slack + 1):
            around[d:] |= bit[:-d]
            around[:-d] |= bit[d:]
        words = np.pad(query.text, edge, constant_values=-2)
        bits = np.uint64(1) << (words % 64).astype(np.uint64)
        found = []
        for n in np.unique(query.lengths).tolist():
            starts = query.starts[query.lengths == n]
            owner = np.full(len(words), -1, np.int64)
            owner[starts + edge] = query.owner[query.lengths == n]
            spare = n - int(np.ceil(share * n))
            # Of n words at most ``spare`` may be missing, so one of the spare + 1 rarest must
            # be there. Windows that share such an anchor are looked up together.
            anchors = []
            for at in np.array_split(starts, -(-len(starts) * n // pairs)):
                count = self.count[query.text[at[:, None] + np.arange(n)]]
                rarest = np.argsort(count, axis=1, kind="stable")[:, : spare + 1]
                anchors.append(np.unique((at[:, None] + rarest)[(count == 0).sum(1) <= spare]))
            anchor = np.unique(np.concatenate(anchors))
            anchor = anchor[self.count[query.text[anchor]] > 0]
            total = np.cumsum(self.count[query.text[anchor]])
            for mine in np.split(anchor, np.unique(np.searchsorted(total, np.arange(pairs, int(total[-1]) if len(total) else 0, pairs)))):
                per = self.count[query.text[mine]]
                a = np.repeat(mine + edge, per)
                p = self.positions[np.repeat(self.begin[query.text[mine]] - np.cumsum(per) + per, per) + np.arange(len(a))] + edge
                # Half of the window's words or more lie on one side of the anchor.
                left, right = np.zeros(len(a), np.int16), np.zeros(len(a), np.int16)
                for k in range(1, n // 2 + 1):
                    left += (around[p - k] & bits[a - k]) == 0
                    right += (around[p + k] & bits[a + k]) == 0
                    few = (left <= spare) | (right <= spare)
                    a, p, left, right = a[few], p[few], left[few], right[few]
                for k in range(0, len(a), max(1, pairs // (2 * n))):
                    rows = slice(k, k + max(1, pairs // (2 * n)))
                    found += self._held(text, words, owner, a[rows], p[rows], edge, n, spare, slack)
        if not found:
            return none, none
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]

    def _held(self, text: np.ndarray, words: np.ndarray, owner: np.ndarray, a: np.ndarray, p: np.ndarray, edge: int, n: int, spare: int, slack: int) -> Iterator[np.ndarray]:
        """(text, owner) of the windows of ``n`` words around query words ``a`` that hold
        where these stand within ``slack`` places of ``p``, compared word by word."""
        doc = np.searchsorted(self.first, p - edge, side="right") - 1
        low, high = self.first[doc][:, None] + edge, self.first[doc + 1][:, None] + edge
        reach = np.arange(1 - n, n)
        want = words[a[:, None] + reach]
        for shift in range(-slack, slack + 1):
            place = (p + shift)[:, None] + reach
            there, exact = np.zeros(want.shape, bool), np.zeros(want.shape, bool)
            for d in range(-slack, slack + 1):
                same = (text[place + d] == want) & (place + d >= low) & (place + d < high)
                there |= same
                if not d:
                    exact = same
            sums = lambda x: np.pad(np.cumsum(x, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
            hits, firm = sums(there), sums(exact)
            whose = owner[a[:, None] + reach[:n]]
            ok = (whose >= 0) & (hits[:, n:] - hits[:, :n] >= n - spare) & (firm[:, n:] > firm[:, :n])
            r, c = np.nonzero(ok)
            if len(r):
                yield np.unique(np.stack((doc[r], whose[r, c]), 1), axis=0)


def held(block: Broadcast, drop: bool) -> object:
    """The value of a broadcast block; with ``drop`` a worker doesn't keep it, so it
    holds one block at a time."""
    value = block.value
    if drop:
        block.__dict__.pop("_value", None)
    return value


def leaked(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", test_key: str = "question_id", test_payload: str = "gold_payload", size: int = 15, least: int = 8, block_rows: int = 20_000, slack: int | None = None, share: float = 0.9, stride: int | None = None) -> DataFrame:
    """Every pair of a document and a test item of which it contains a passage.

    Without ``slack`` a passage is exact: ``size`` words in a row of one string
    value of the payload, or all words of its question where that has ``least`` to
    ``size`` - 1. With ``slack``, at least ``share`` of such a window's words, each
    within ``slack`` places of its own, one of them exactly there. Windows begin at
    every ``stride``-th word of a value: 1 is all windows, and what is taken for exact
    passages. With ``slack`` the default is ``size``, windows that follow each other
    without overlap, which see only part of the passages.

    The test items are a stated query set. They are sent to all executors in blocks of
    ``block_rows`` rows, of which a worker holds one at a time, however many there
    are; only their words' numbers are held throughout. Documents are read once. Null and empty texts
    and payloads give no pairs; items with a null key are left out; repeated rows
    give each pair once. Whole texts are indexed. Other columns are not carried.
    """
    src = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = tests.select(F.col(test_key).alias("k"), F.col(test_payload).cast("string").alias("p")).filter("k IS NOT NULL AND p IS NOT NULL").distinct()
    n = rows.count()
    kinds = f"`{key}` {src.schema[0].dataType.simpleString()}, `{test_key}` {rows.schema[0].dataType.simpleString()}"
    parts = max(1, -(-n // block_rows))
    spark = docs.sparkSession
    vocabulary: dict[str, int] = {}
    blocks = []
    for block in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("k", "p"), F.lit(parts)) == block) if parts > 1 else rows
        blocks.append(spark.sparkContext.broadcast(Passages([(r.k, r.p) for r in mine.collect()], vocabulary, size, least, stride or (1 if slack is None else size))))
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            index = Index(b.column(1).to_pylist(), known.value)
            for block in blocks:
                q = held(block, len(blocks) > 1)
                doc, owner = index.phrases(q) if slack is None else index.near(q, slack, share)
                pairs = sorted({(d, q.keys[o]) for d, o in zip(doc.tolist(), owner.tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([k for _, k in pairs], types[1])], names=[key, test_key])

    types = pa.schema(spark.createDataFrame([], kinds).toArrow().schema).types
    return src.mapInArrow(run, kinds).distinct()
