"""Statistics and kinds of lines look at the whole text."""

import random

from lekha.llm import quality

COMMON = frozenset({"the", "of"})


def test_repetition_late_in_a_text_counts():
    r = random.Random(1)
    fresh = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(800)]
    at = quality.STATS.index("distinct_share")
    share = lambda ws: quality.statistics(" ".join(ws), COMMON)[at]
    assert share(fresh) == 1
    assert share(fresh[:400] + ["budget"] * 400) == (400 + 1) / 800
    assert share(fresh[:400] + ["budget"] * 4) == (400 + 1) / 404
    few = [r.choice(fresh) for _ in range(300)]
    assert share(few) == len(set(few)) / 300


def lines_of(words, n=10):
    return [" ".join(words[k : k + n]) for k in range(0, len(words), n)]


def test_only_the_repeated_part_of_a_run_is_junk():
    r = random.Random(2)
    plain = [x for _ in range(60) for x in ("the", f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrt')}{r.choice('aeiou')}{r.choice('xyzkp')}")]
    again = ["budget", "tariff", "port"] * 80
    assert len(set(plain)) > 50
    for rows, junk in ((lines_of(plain + again), range(12, 36)), (lines_of(again + plain), range(24))):
        kinds = quality.line_kinds(rows, COMMON)
        wrong = [i for i, k in enumerate(kinds) if (k == "junk") != (i in junk)]
        assert len(wrong) <= 2, kinds  # the lines where one passes into the other
    # Sentences before it don't hide it, and sentences are none.
    prose = [f"The {w} of the {v} was read." for w, v in zip(plain[1::2], plain[3::2], strict=False)]
    kinds = quality.line_kinds([*prose, *lines_of(again[:120])], COMMON)
    assert set(kinds[: len(prose) - 1]) == {"prose"} and set(kinds[len(prose) + 2 :]) == {"junk"}


def test_wide_rows_of_commas_are_a_table():
    row = ",".join(str(1000 + i) for i in range(100))
    assert len(row) > 400
    assert quality.line_kinds([row, row], COMMON) == ["table", "table"]
