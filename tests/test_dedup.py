"""Duplicates against brute force."""

import itertools
import random

from lekha.operators import dedup

WORDS = [f"w{i}" for i in range(400)]


def near_docs():
    r = random.Random(3)
    docs = []
    for k in range(30):
        base = r.choices(WORDS, k=80)
        for c in range(r.randint(1, 3)):
            x = list(base)
            for _ in range(c):
                x[r.randrange(80)] = r.choice(WORDS)
            docs.append((len(docs), " ".join(x)))
    docs += [(len(docs), docs[0][1]), (len(docs) + 1, docs[0][1].upper()), (len(docs) + 2, ""), (len(docs) + 3, "too few words"), (len(docs) + 4, None)]
    return docs


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_lose_no_link(spark):
    docs = near_docs()
    sets = {d: grams(t) for d, t in docs}
    first = {}
    for d, s in sorted(sets.items()):
        if s:
            first.setdefault(frozenset(s), d)
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    n = dedup.NearDuplicates(spark.createDataFrame(docs, "doc_id int, text string"))
    assert {(r.doc_a, r.doc_b) for r in n.pairs().collect()} == want
    assert want
    out = {r.doc: r for r in n.documents().collect()}
    assert len(out) == len(docs)
    kept = []
    for d in sorted(first.values()):
        if not any((k, d) in want for k in kept):
            kept.append(d)
    plain = [d for d, s in sets.items() if not s]
    assert {d for d, r in out.items() if r.kept} == {*kept, *plain}
    assert all(out[d].class_id == first[frozenset(s)] for d, s in sets.items() if s)


def test_a_chain_keeps_both_ends(spark):
    # a~b and b~c, but not a~c: b goes, c stays.
    w = [f"x{i}" for i in range(100)]
    b, c = list(w), list(w)
    b[50] = "y"
    c[50], c[10], c[30] = "y", "z", "q"
    docs = [(1, " ".join(w)), (2, " ".join(b)), (3, " ".join(c))]
    kept = {r.doc for r in dedup.near_duplicates(spark.createDataFrame(docs, "doc_id int, text string")).filter("kept").collect()}
    pairs = {(r.doc_a, r.doc_b) for r in dedup.NearDuplicates(spark.createDataFrame(docs, "doc_id int, text string")).pairs().collect()}
    assert pairs == {(1, 2), (2, 3)}
    assert kept == {1, 3}


def test_keep_first_and_last(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "z"), ("b", None, "q")], "k string, o int, v string")
    assert {tuple(r) for r in dedup.keep_first(rows, ["k"], ["o"]).collect()} == {("a", 1, "y"), (None, 3, "z"), ("b", None, "q")}
    assert {tuple(r) for r in dedup.keep_last(rows, ["k"], ["o"]).collect()} == {("a", 2, "x"), (None, 4, "z"), ("b", None, "q")}
    assert dedup.keep_first(rows.limit(0), ["k"], ["o"]).count() == 0


def test_empty_table(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0
