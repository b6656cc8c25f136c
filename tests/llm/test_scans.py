"""Repair of scanned pages: held-out accuracy on pages with known marks."""

import random

import numpy as np
import pytest

from lekha.llm import scans
from lekha.llm.boosting import Boosted

WORDS = "council market harvest treaty valley province ministry reform settlement industrial governor revenue agriculture historical commission northern estimated delivered recorded considered departments temperature important political statement".split()
COMPOUNDS = ["land-locked", "long-term", "self-governing", "cross-border", "rain-fed"]


def page_file(r, n_pages, title):
    """Lines and the marks put into them."""
    out, want = [], set()
    number = r.randint(5, 200)
    for p in range(n_pages):
        want.add((len(out), "running"))
        out.append(title)
        for _ in range(14):
            ws = [r.choice(WORDS) if r.random() > 0.1 else r.choice(COMPOUNDS) for _ in range(7)]
            out.append("the " + " ".join(ws))
        want.add((len(out), "page_no"))
        out.append(f"- {number + p} -")
        out.append("\x0c")
    text = [i for i, x in enumerate(out) if x.startswith("the ")]
    for i in r.sample(text, len(text) // 5):
        ws = out[i].split()
        k = r.randrange(1, len(ws))
        bad = scans.misread_line(ws[k], np.random.default_rng(r.randrange(10**6)), 1)
        if bad != ws[k] and "-" not in ws[k]:
            out[i] = " ".join([*ws[:k], bad, *ws[k + 1 :]])
            want.add((i, "misread"))
    for i, j in zip(text, text[1:], strict=False):
        if r.random() < 0.2 and (i, "misread") not in want and (j, "misread") not in want:
            w = r.choice([x for x in WORDS if len(x) > 6])
            at = r.randint(2, len(w) - 3)
            out[i] += " " + w[:at] + "-"
            out[j] = w[at:] + " " + out[j]
            want.add((i, "hyphen"))
        elif r.random() < 0.05:
            c = r.choice(COMPOUNDS).split("-")
            out[i] += f" {c[0]}-"
            out[j] = f"{c[1]} {out[j]}"
    return "\n".join(out), want


def test_marks_of_made_up_files(spark):
    r = random.Random(8)
    rows, want = [], set()
    for f in range(60):
        n = r.randint(3, 6)
        text, marks = page_file(r, n, f"{r.choice(WORDS).title()} And {r.choice(WORDS).title()}")
        rows.append((f, text, n))
        want |= {(f, *m) for m in marks}
    rows += [(900, None, 3), (901, "", 0), (902, "one line only", None), (None, "no key", 1), rows[0]]
    df = spark.createDataFrame(rows, "file_id long, md_text string, n_pages int")
    found = [(x.file_id, x.line_no, x.kind) for x in scans.scan_marks(df).collect()]
    got = set(found)
    assert len(found) == len(got)
    for kind, least in (("running", 0.98), ("page_no", 0.98), ("hyphen", 0.95), ("misread", 0.9)):
        a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
        assert len(a & b) >= least * len(b), kind
        assert len(a & b) >= least * len(a), kind


@pytest.mark.parametrize("files", [40, 200, 800])
def test_recall_of_misread_words_does_not_fall_with_size(spark, files):
    r = random.Random(files)
    rows, want = [], set()
    for f in range(files):
        text, marks = page_file(r, 3, f"{r.choice(WORDS).title()} And {r.choice(WORDS).title()}")
        rows.append((f, text, 3))
        want |= {(f, i) for i, kind in marks if kind == "misread"}
    got = {(x.file_id, x.line_no) for x in scans.scan_marks(spark.createDataFrame(rows, "file_id long, md_text string, n_pages int")).filter("kind = 'misread'").collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got & want) >= 0.95 * len(got)


def test_copies_of_files_change_nothing(spark):
    r = random.Random(3)
    rows = [(f, page_file(r, 3, "Harvest And Treaty")[0], 3) for f in range(30)]
    count = []
    for times in (1, 5, 20):
        df = spark.createDataFrame([(1000 * t + f, text, n) for t in range(times) for f, text, n in rows], "file_id long, md_text string, n_pages int")
        count.append(scans.scan_marks(df).filter("kind = 'misread'").count() / times)
    assert max(count) - min(count) <= 0.05 * max(count)


def test_candidates_by_rarest_bigrams_are_all_that_share_enough(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abcde") for _ in range(r.randint(3, 9))): r.randint(1, 400) for _ in range(400)} | {"aaaa": 9, "aaaab": 90, "abababab": 7, "bababab": 80}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(x.word, x.right) for x in scans.Scans._pairs(None, df, df).collect()}
    for a, n in words.items():
        for b, m in words.items():
            shared, least = scans.shared_grams(a, b)
            if a != b and m >= scans.TIMES * n and abs(len(a) - len(b)) <= 2 and shared >= least:
                assert (a, b) in got


def test_long_running_lines_and_wide_page_numbers_are_seen():
    title = "Proceedings Of The Standing Committee On Harbours, Tariffs And Coastal Settlements, Held In The Second Session Of The Council At Tarapur"
    text = f"{title}\nx y z.\n-              12              -\n{title}\nq r s.\n-              13              -"
    page = scans.Page(text, 2)
    page.running(None)
    assert page.kinds == ["running", "text", "page_no"] * 2


def test_empty_table(spark):
    assert scans.scan_marks(spark.createDataFrame([], "file_id long, md_text string, n_pages int")).count() == 0


@pytest.mark.parametrize(("text", "n", "want"), [("a b c.\n1999\nd e f.", 3, set()), ("Page 3\nx y z.\nPage 4\nq r s.", 2, {0, 2}), ("x y.\nii\ny z.\niii\n", 2, {1, 3}), ("Table 9\nx y.\n-----\n22   73   391", 4, set()), ("x.\n[9O9]\ny.\n[910]", 2, {1, 3})])
def test_page_numbers(text, n, want):
    page = scans.Page(text, n)
    assert {i for i, k in enumerate(page.kinds) if k == "page_no"} == want


def test_boosting_learns_a_rule_it_was_not_shown():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = Boosted(rounds=40).fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
