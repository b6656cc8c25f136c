"""Overlaps, passages and defects against brute force."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from lekha.llm import defects, overlap, passages

VOCABULARY = [f"word{i}" for i in range(300)]


def edited(words, n, r):
    w = list(words)
    for _ in range(n):
        kind, i = r.choice("sdai"), r.randrange(len(w))
        if kind == "s":
            w[i] = r.choice(VOCABULARY)
        elif kind == "d" and len(w) > 2:
            del w[i]
        else:
            w.insert(i, r.choice(VOCABULARY))
    return w


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_segment_join_equals_brute_force():
    r = random.Random(11)
    evals = [[r.choice(VOCABULARY) for _ in range(r.choice([3, 6, 12, 25, 80]))] for _ in range(60)]
    train = [edited(r.choice(evals), r.randint(0, 9), r) for _ in range(400)] + [[], ["word1"], evals[0] + evals[1]]
    s = overlap.Segments([((i,), e) for i, e in enumerate(evals)])
    got = set(s.matches(train))
    want = set()
    often = Counter(w for v in evals for w in set(v))
    rare_of = [{w for w in v if often[w] <= max(1, overlap.RARE * len(evals))} for v in evals]
    for d, t in enumerate(train):
        for e, v in enumerate(evals):
            n = max(len(t), len(v))
            if t and n - common(v, t) <= overlap.allowed(n):
                rare = rare_of[e]
                if len(rare) <= 3 or len(rare & set(t)) >= np.ceil(overlap.KEPT * len(rare)):
                    want.add((d, e))
    assert got == want and len(want) > 100


def test_banded_rows_equal_the_whole_table():
    r = random.Random(3)
    for _ in range(50):
        a = [r.randint(0, 5) for _ in range(r.randint(0, 20))]
        b = [r.randint(0, 5) for _ in range(r.randint(0, 20))]
        assert overlap.common_words(np.array(a), np.array(b), 40) == common(a, b)


@pytest.mark.parametrize("text", ["Q. 27 Which river?", "<p>Which river?</p>", "which  RIVER", "12) Which river? [10 marks]", "(Mock 7) Which river?", "Which river? (15 marks, 250 words)"])
def test_decoration_is_set_aside(text):
    assert overlap.plain(text) == ["which", "river"]


def test_overlaps(spark):
    q = "Discuss how the northern council shaped the grain market of the old port before the long famine."
    art = " ".join(f"Sentence {VOCABULARY[i]} says {VOCABULARY[i + 1]} of {VOCABULARY[i + 2]}." for i in range(20))
    splits = [("locked", "pyq:AA-1:en", json.dumps({"question": q})), ("locked", "news:n1", json.dumps({"source_text": art})), ("holdout", "plain", json.dumps({"question": None})), ("locked", None, "{}"), ("locked", "x:", "not json"), ("locked", "pyq:AA-1:en", json.dumps({"question": q}))]
    train = [(" PYQ: aa-1 :HI", None), ("t1", json.dumps({"question": "Q12. " + q.replace("grain", "corn") + " [10 marks]"})), ("t2", json.dumps({"question": "Discuss how the southern league shaped the cloth trade of the new town before the long war."})), ("t3", json.dumps({"article": art.replace("says", "said", 3)})), ("t4", json.dumps({"question": art})), ("t1", json.dumps({"question": q})), (None, "{}"), ("x:", "{}")]
    s = spark.createDataFrame(splits, "split string, question_id string, payload string")
    t = spark.createDataFrame(train, "pair_id string, input string")
    got = sorted((r.split, r.question_id, r.pair_id) for r in overlap.overlaps(s, t).collect())
    assert got == [("locked", "news:n1", "t3"), ("locked", "pyq:AA-1:en", " PYQ: aa-1 :HI"), ("locked", "pyq:AA-1:en", "t1")]
    assert overlap.overlaps(s, t, block_rows=2).count() == 3
    assert overlap.overlaps(s.limit(0), t).count() == 0
    assert overlap.overlaps(s, t.limit(0)).count() == 0


def corpus(r):
    evals = [(f"q{i}", json.dumps({"question": " ".join(r.choices(VOCABULARY, k=r.choice([5, 8, 14, 40]))), "options": [{"id": "a", "text": " ".join(r.choices(VOCABULARY, k=20))}], "x": None})) for i in range(30)]
    docs = []
    for i in range(200):
        w = r.choices(VOCABULARY, k=r.randint(0, 60))
        if i % 3 == 0:
            src = passages.words(r.choice(passages.payload(evals[r.randrange(30)][1])[0]))
            n = r.choice([8, 14, 15, 16, 40])
            at = r.randint(0, max(0, len(src) - n))
            p = r.randint(0, len(w))
            w[p:p] = [x.upper() for x in src[at : at + n]]
        docs.append((i, ", ".join(w)))
    return evals, docs


def test_passages_equal_brute_force(spark):
    evals, docs = corpus(random.Random(5))
    want = set()
    for k, raw in evals:
        values, question = passages.payload(raw)
        for d, t in docs:
            ws = passages.words(t)
            joined = " " + " ".join(ws) + " "
            for v in values:
                x = passages.words(v)
                if any(" " + " ".join(x[i : i + 15]) + " " in joined for i in range(len(x) - 14)):
                    want.add((d, k))
            x = passages.words(question)
            if 8 <= len(x) <= 14 and " " + " ".join(x) + " " in joined:
                want.add((d, k))
    tests = spark.createDataFrame([*evals, (None, "{}"), ("null", None), ("bad", "no json at all"), evals[0]], "question_id string, gold_payload string")
    df = spark.createDataFrame([*docs, (999, None), (998, ""), (0, docs[0][1])], "doc_id long, text string")
    got = [(r.doc_id, r.question_id) for r in passages.leaked(df, tests).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert passages.leaked(df, tests, block_rows=7).count() == len(want)
    # Proximity matches against brute force, over windows without overlap.
    near = {(r.doc_id, r.question_id) for r in passages.leaked(df, tests, slack=2, share=0.9).collect()}
    close = set()
    for k, raw in evals:
        values, question = passages.payload(raw)
        qs = [passages.words(v) for v in values]
        windows = [x[i : i + 15] for x in qs for i in range(0, len(x) - 14, 15)]
        x = passages.words(question)
        windows += [x] if 8 <= len(x) <= 14 else []
        for d, t in docs:
            ws = passages.words(t)
            for w in windows:
                for p in range(-len(w), len(ws)):
                    there = [any(0 <= q < len(ws) and ws[q] == v for q in range(p + i - 2, p + i + 3)) for i, v in enumerate(w)]
                    exact = any(0 <= p + i < len(ws) and ws[p + i] == v for i, v in enumerate(w))
                    if exact and sum(there) >= np.ceil(0.9 * len(w)):
                        close.add((d, k))
                        break
    assert near <= close and len(near) >= 0.95 * len(close) and close - want
    assert passages.leaked(df.limit(0), tests).count() == 0
    assert passages.leaked(df, tests.limit(0)).count() == 0


def test_words_are_letters_marks_and_digits():
    assert passages.words("Naïve, ét 12½ नमस्ते_x²") == ["naïve", "ét", "12", "नमस्ते", "x"]


QUESTION = "Discuss how the northern council shaped the grain market of the old port before the long famine."
ANSWER = "The council set the price of corn and paid the growers late. It was not until the port had been rebuilt that trade came back to the town, and the market was free for all of them."
ENDS = defects.TerminalContexts.fit([json.dumps({"answer": ANSWER}) for _ in range(30)] + [ANSWER] * 30 + [json.dumps({"answer": ANSWER + "\n- Corn prices\n- Port works"}) for _ in range(4)])


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A", "empty"), ("{}", "empty"), ("```json\n```", "empty"), ('{"answer": null, "explanation": "-"}', "empty"), ("...", "empty"),
        ("C", None), ("Answer: B", None), ('{"answer": "D", "explanation": ""}', None), (json.dumps({"answer": ANSWER}), None), (ANSWER, None), (f"```json\n{json.dumps({'answer': ANSWER})}\n```", None),
        (json.dumps({"answer": ANSWER})[:120], "truncated"), (ANSWER[:100], "truncated"), (json.dumps({"answer": ANSWER[:101]}), "truncated"),
        ("I'm sorry, but I can't help with this question.", "refusal"), ('{"answer": null, "explanation": "As a study assistant, I must decline to give a view."}', "refusal"), ("मैं इस विषय पर टिप्पणी करने में असमर्थ हूं।", "refusal"),
        ("The tribes refused the treaty and were unable to pay. " + ANSWER, None),
        (QUESTION, "copy"), (QUESTION.lower().replace(",", ""), "copy"), (f"The question is: {QUESTION}", "copy"), (f"{QUESTION} {ANSWER}", None),
        ("परिषद ने कर को स्थगित किया और नगर की घाटी में बाढ़ आई। वर्ष 1923 में मंत्रालय ने समिति को पुनर्गठित किया।", "language"), ("El consejo de la ciudad redujo el precio del maíz y la provincia pagó tarde a los campesinos.", "language"), ("The परिषद of the old town paid the growers of the port late, and it was not rebuilt.", None),
    ],
)
def test_defects(raw, want):
    assert defects.defect(raw, json.dumps({"question": QUESTION, "paper": "GS1"}), "en", "B", ENDS) == want


def test_only_the_latest_prediction_counts(spark):
    key = ("r", "C1", "q", "B")
    rows = [(*key, "en", QUESTION, ANSWER, "2025-01-02T00:00:00Z"), (*key, "en", QUESTION, "N/A", "2025-01-01T23:00:00+00:00"), ("r", "C1", "q2", "B", None, None, None, None), ("r", "C1", "q2", "B", None, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, condition string, question_id string, inference_task string, language string, input_text string, raw_output string, created_at string")
    got = [(r.question_id, r.defect) for r in defects.prediction_defects(df, ENDS).collect()]
    assert got == [("q2", "empty")]
    c = spark.createDataFrame([("a", "B", "en", "{}", "x", None), ("a", "B", "en", "{}", "x", None), (None, "B", "en", "{}", "x", None)], "pair_id string, task string, language string, input string, instruction string, output string")
    assert [(r.pair_id, r.defect) for r in defects.corpus_defects(c, ENDS).collect()] == [("a", "empty")]
    assert defects.corpus_defects(c.limit(0), defects.fit_ends(c.select(c.output.alias("answer")))).count() == 0
