"""Operators take the whole text and all of its windows."""

import json
import random

import numpy as np

from lekha.llm import mixing, overlap, passages

VOCABULARY = [f"word{i}" for i in range(300)]


def close_pairs(evals, docs, slack, share):
    """Proximity matches of all windows by brute force."""
    out = set()
    for k, raw in evals:
        values, question = passages.payload(raw)
        windows = [x[i : i + 15] for x in map(passages.words, values) for i in range(len(x) - 14)]
        x = passages.words(question)
        windows += [x] if 8 <= len(x) <= 14 else []
        for d, t in docs:
            ws = passages.words(t)
            for w in windows:
                for p in range(-len(w), len(ws)):
                    there = sum(v in ws[max(0, p + i - slack) : max(0, p + i + slack + 1)] for i, v in enumerate(w))
                    if there >= np.ceil(share * len(w)) and any(0 <= p + i < len(ws) and ws[p + i] == v for i, v in enumerate(w)):
                        out.add((d, k))
                        break
    return out


def test_proximity_of_all_windows_equals_brute_force(spark):
    r = random.Random(8)
    evals = [(f"q{i}", json.dumps({"question": " ".join(r.choices(VOCABULARY, k=r.choice([8, 12, 40]))), "note": " ".join(r.choices(VOCABULARY, k=29))})) for i in range(6)]
    docs = []
    for i in range(40):
        src = passages.words(r.choice(passages.payload(evals[r.randrange(6)][1])[0]))
        at = r.randint(0, max(0, len(src) - 15))
        quote = src[at : at + 15]
        for _ in range(r.randint(0, 3)):
            j = r.randrange(len(quote) - 1)
            quote[j : j + 2] = r.choice([quote[j : j + 2][::-1], [quote[j], "other", quote[j + 1]], [quote[j]]])
        docs.append((i, " ".join(r.choices(VOCABULARY, k=r.randint(0, 20)) + quote + r.choices(VOCABULARY, k=r.randint(0, 9)))))
    # The last words of one text and the first of the next are no passage.
    long = passages.words(evals[0][1])[-15:]
    docs += [(100, " ".join(long[:8])), (101, " ".join(long[8:]))]
    tests = spark.createDataFrame(evals, "question_id string, gold_payload string")
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    pairs = lambda **x: {(q.doc_id, q.question_id) for q in passages.leaked(df, tests, **x).collect()}
    want = close_pairs(evals, docs, 2, 0.9)
    exact, near = pairs(), pairs(slack=2, share=0.9, stride=1)
    assert near == want and exact < near
    assert pairs(slack=2, share=0.9) < near
    assert pairs(slack=1, share=0.7, stride=1) == close_pairs(evals, docs, 1, 0.7)


def test_a_source_that_may_give_nothing_leaves_the_others(spark):
    kinds = "source string, target_share double, cap_tokens long, max_repeat double, optional boolean"
    docs = spark.createDataFrame([(i, "abc"[i % 3], i, i, 10) for i in range(90)], "doc_id long, source string, h1 long, h2 long, n_tokens long")
    for cap, repeat in ((0, 1.0), (None, 0.0)):
        mix = spark.createDataFrame([("a", 0.3, None, 1.0, None), ("b", 0.3, None, 1.0, None), ("c", 0.4, cap, repeat, None)], kinds)
        got = {r.source: (r.tokens, r.share) for r in mixing.shares(docs, mix, mixing.select(docs, mix)).collect()}
        assert got["c"][0] == 0
        assert got["a"] == got["b"] == (300, 0.5)


def test_edits_on_rare_words_are_edits():
    frame = ["discuss", "the", "role", "of", "in", "india"]
    texts = [[*frame, *[f"rare{i}{c}" for c in "abcd"]] for i in range(40)]
    changed = [*texts[0][:-2], "one", "two"]
    assert overlap.Segments([((i,), t) for i, t in enumerate(texts)]).matches([changed, [*frame, "rare0a", "x", "y", "z"]]) == [(0, 0)]


def test_blocks_of_the_query_set_change_nothing(spark):
    r = random.Random(12)
    evals = [(f"q{i}", json.dumps({"question": " ".join(r.choices(VOCABULARY[:80], k=r.choice([6, 12, 40])))})) for i in range(30)]
    docs = []
    for i in range(90):
        t = passages.words(passages.payload(r.choice(evals)[1])[1])
        at = r.randint(0, max(0, len(t) - 16))
        docs.append((i, " ".join([*r.choices(VOCABULARY, k=r.randint(0, 9)), *t[at : at + 16]])))
    tests = spark.createDataFrame(evals, "question_id string, gold_payload string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    splits = tests.selectExpr("'locked' AS split", "question_id", "gold_payload AS payload")
    train = spark.createDataFrame([(str(d), json.dumps({"question": t})) for d, t in docs] + [(k, v) for k, v in evals], "pair_id string, input string")
    for run in (lambda **x: passages.leaked(df, tests, **x), lambda **x: passages.leaked(df, tests, slack=2, stride=1, **x), lambda **x: overlap.overlaps(splits, train, **x)):
        whole, parts = ({tuple(q) for q in run(block_rows=n).collect()} for n in (1000, 4))
        assert whole == parts and len(whole) > 20


def test_planted_edits_are_found_by_proximity(spark):
    r = random.Random(21)
    evals = [(f"q{i}", json.dumps({"question": " ".join(r.choices(VOCABULARY, k=60))})) for i in range(20)]
    docs, want = [], set()
    for i in range(200):
        q, raw = r.choice(evals)
        t = passages.words(passages.payload(raw)[1])
        at = r.randint(0, 38)
        quote = t[at : at + 22]
        for _ in range(2):
            j = r.randrange(1, 20)
            quote[j : j + 2] = r.choice([quote[j : j + 2][::-1], [quote[j], "other", quote[j + 1]], ["other", quote[j + 1]]])
        docs.append((i, " ".join([*r.choices(VOCABULARY, k=20), *quote, *r.choices(VOCABULARY, k=20)])))
        want.add((i, q))
    tests = spark.createDataFrame(evals, "question_id string, gold_payload string")
    got = {tuple(x) for x in passages.leaked(spark.createDataFrame(docs, "doc_id long, text string"), tests, slack=2, stride=1).collect()}
    assert len(got & want) >= 0.9 * len(want)
