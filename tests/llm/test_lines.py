"""Repeated lines, statistics and classes against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lekha.llm import lines, quality

SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def normal(line):
    return re.sub(f"[!-@\\[-`{{-~{SPACE}]+", " ", line).strip(" ").lower()


def corpus():
    r = random.Random(7)
    rows = []
    for i in range(400):
        source = r.choices(["hot", "small", None], [5, 1, 1])[0]
        body = [f"own line {i} {r.random()}" for _ in range(r.randint(0, 4))]
        if r.random() < 0.3:
            body += ["Share this!", "© 2024, ALL rights reserved"]
        if r.random() < 0.03:
            body.append("rare line")
        if r.random() < 0.05:
            body += ["", "  ", "123 ---"]
        rows.append((i, source, "\n".join(body) if i % 50 else None))
    rows += [(3, "hot", "Share this 5"), (None, "hot", "share THIS"), (None, "hot", "share this"), (900, "few", "x\nx"), (901, "few", "x x\nx")]
    return rows


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_repeated_lines_equal_brute_force(spark, shard_rows):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, line_no string")
    n, where = defaultdict(int), defaultdict(set)
    for d, s, t in rows:
        n[s] += 1
        for x in (t or "").split("\n") if t is not None else ():
            if normal(x):
                where[s, normal(x)].add(d)
    found = {k for k, v in where.items() if len(v) >= 5 and len(v) * 20 >= n[k[0]]}
    want = {(d, i) for d, s, t in rows if t is not None for i, x in enumerate(t.split("\n")) if (s, normal(x)) in found}
    got = [(r.doc_id, r.line_no) for r in lines.repeated(df, shard_rows=shard_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and want


def test_removal(spark):
    rows = [(i, "s", f"own {chr(97 + i)}\nFooter {i}\nend {chr(97 + i)}") for i in range(6)] + [(9, "s", None), (10, "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.removed(df, lines.repeated(df)).collect()}
    assert out[0] == ("own a\nend a", 1)
    assert out[9] == (None, 0) and out[10] == ("", 0)
    assert lines.repeated(df.limit(0)).count() == 0


def test_suffix_array_and_blocks_equal_brute_force():
    r = random.Random(2)
    for _ in range(40):
        docs = [[r.randint(1, 4) for _ in range(r.randint(0, 8))] for _ in range(6)]
        ids, doc = [], []
        for k, d in enumerate(docs):
            ids += [*d, 100 + k]
            doc += [*[k] * len(d), -1]
        a, ranks = lines.suffix_array(np.array(ids))
        assert a.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])
        lcp = lines.common_prefixes(a, ranks)
        for i in range(1, len(a)):
            x, y = ids[a[i - 1] :], ids[a[i] :]
            n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[i] == n
        got = {tuple(ids[s : s + n]): k for s, n, k, _ in lines.blocks(np.array(ids), np.array(doc), 2)}
        spans = defaultdict(set)
        for k, d in enumerate(docs):
            for i in range(len(d)):
                for j in range(i + 1, len(d) + 1):
                    spans[tuple(d[i:j])].add(k)
        assert all(len(spans[b]) == k for b, k in got.items())
        # Every line in two documents begins a block that was found.
        assert {b[0] for b, v in spans.items() if len(b) == 1 and len(v) > 1} == {b[0] for b in got}


def test_line_id_equals_spark(spark):
    given = ["A b, c!", "", "  ", "9 x y", "नमस्ते, दुनिया", "ÉCOLE № 5", "tab\there", " lead"]
    df = spark.createDataFrame([("\n".join(given),)], "t string")
    assert df.select(lines.line_ids(df.t)).first()[0] == [quality.line_id(x) for x in given]


COMMON = frozenset("the of and to in a is that for it as was with be by on not he at this have from or had which were all when who will".split())


@pytest.mark.parametrize(("kind", "text"), quality.EXAMPLES)
def test_shares_of_examples(kind, text):
    s = dict(zip(quality.STATS, quality.statistics(text, COMMON), strict=True))
    shares = {k: s[f"{k}_share"] for k in ("list", "table", "junk")}
    if kind == "prose":
        assert max(shares.values()) <= 0.5
    else:
        assert shares[kind] > 0.5


def test_blank_texts_and_recurring_lines():
    assert quality.statistics(None, COMMON) == quality.statistics(" \n ", COMMON) == (0.0,) * len(quality.STATS)
    text = "- a b\n- c d\n- e f\nThe council met in the town and it was glad that the vote was over."
    skip = {quality.line_id(x) for x in ("a b", "c d", "e f")}
    at = quality.STATS.index("list_share")
    assert quality.statistics(text, COMMON)[at] > 0
    assert quality.statistics(text, COMMON, skip)[at] == 0


def test_classes_of_a_small_corpus(spark):
    r = random.Random(1)
    words = "federal council market harvest treaty river valley province ministry reform".split()
    rows, want = [], {}

    def name():
        """Lines that differ, as a line that recurs is set aside."""
        return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4)).title()

    for i in range(120):
        kind = ("prose", "prose", "prose", "list", "table", "junk")[i % 6]
        if kind == "prose":
            t = " ".join(f"The {r.choice(words)} of the {r.choice(words)} was not in the {r.choice(words)} when it had {r.choice(words)}s." for _ in range(8))
        elif kind == "list":
            t = "\n".join(f"- {name()} {r.choice(words)}" for _ in range(12))
        elif kind == "table":
            t = "\n".join(f"{name()} {r.choice(words)};{r.random():.2f};{r.randint(1, 99)};n.a." for _ in range(12))
        else:
            t = "\n".join(f"var {name()}{i}=function(){{return {r.choice(words)}[{i}]||{r.randint(1, 9)};}};" for _ in range(12))
        rows.append((i, "s", t))
        if kind != "prose":
            want[i] = kind
    rows += [(500, "s", None), (501, "s", ""), (502, None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    assert {r.doc_id: r.kind for r in quality.not_prose(df, common).collect()} == want
    assert quality.not_prose(df.limit(0), common).count() == 0
