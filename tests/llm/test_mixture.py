"""The mixture decides what a document is, and recurring lines are set aside either way."""

import numpy as np

from lekha.llm import lines, quality

COMMON = frozenset("the of and was in to it that a".split())


def test_recurring_lines_joined_or_sent_out_give_the_same(spark):
    rows = [(i, f"s{i % 2}", f"Share this page\nThe council of town {i} was in the port.\nShare this page") for i in range(40)]
    rows += [(None, "s0", None), (7, "s1", rows[7][2]), (90, None, "Share this page"), (91, "s0", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    recurring = lines.recurring_ids(lines.lines_of(df))
    both = [sorted(map(tuple, quality.stats(df, common, recurring, collect_rows=n).collect()), key=str) for n in (1000, 0)]
    assert both[0] == both[1]
    assert len(both[0]) == len(rows)


def test_kinds_come_from_the_components():
    x = np.array([quality.statistics(t, COMMON) for _, t in quality.EXAMPLES])
    f = quality._features(x)
    centre, scale = f.mean(0), np.maximum(f.std(0), 1e-3)
    k = len(f)
    parts = [(f - centre) / scale, np.full(f.shape, 0.5)]
    kinds = [name for name, _ in quality.EXAMPLES]
    model = quality.Mixture(centre, scale, np.full(k, 1 / k), *parts, kinds)
    assert [quality.KINDS[i] for i in model.by_kind(x).argmax(1)] == kinds
    # Other names for the components are other kinds: nothing beside the mixture decides.
    swapped = quality.Mixture(centre, scale, np.full(k, 1 / k), *parts, ["junk" if n == "table" else n for n in kinds])
    assert [quality.KINDS[i] for i in swapped.by_kind(x).argmax(1)] == swapped.kinds


def test_a_few_marks_are_nothing(spark):
    rows = [(i, "s", t) for i, t in enumerate(["-", "***", " . ", "#", "", None] + ["The council of the town was in the port, and it was late."] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    assert quality.not_prose(df, common).count() == 0
