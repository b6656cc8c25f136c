"""Text functions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lekha.functions import text as T


def run(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    return [r.o for r in df.select("id", fn(F.col("t")).alias("o")).orderBy("id").collect()]


def test_normalize_unicode(spark):
    given = ["“a” – ‘b’…", "3�3�1 S� x � y", "ﬁne １２", None, "", "a b​c﻿"]
    out = run(spark, T.normalize_unicode, given)
    assert out == ["\"a\" - 'b'...", "3.3.1 S. x  y", "fine 12", None, "", "a bc"]


def test_strikethrough(spark):
    assert run(spark, T.strip_strikethrough, ["~~T~~ he ~~old~~ x ~~", "no marks", None]) == ["The old x ", "no marks", None]


@pytest.mark.parametrize(("bad", "good"), [("electon", "election"), ("populaton", "population"), ("conditon", "condition"), ("functon", "function"), ("creatng", "creating"), ("automaton", "automaton"), ("Triton", "Triton"), ("Artcles fnal", "Articles final"), ("baton", "baton"), ("a populaton conditon", "a population condition"), ("populaton populaton", "population population")])
def test_restore_lost_i(spark, bad, good):
    assert run(spark, T.restore_lost_i, [bad]) == [good]


def test_collapse_whitespace(spark):
    assert run(spark, T.collapse_whitespace, ["  a \t b\n   c\n\n\n\nd \n", "", "   "]) == ["a b\nc\n\nd", "", ""]


def test_word_count_splits_at_unicode_space(spark):
    given = ["a b c", "", "  ", "one"]
    assert run(spark, T.word_count, given) == [len(g.split()) for g in given]


def test_devanagari_ratio(spark):
    given = ["abc", "नमस्ते", "123", "ab नम"]
    want = [(len(re.findall("[ऀ-ॿ]", g)) / n) if (n := sum(unicodedata.category(c)[0] == "L" for c in g)) else 0.0 for g in given]
    assert run(spark, T.devanagari_ratio, given) == pytest.approx(want)


def test_ngrams_and_chunks(spark):
    assert run(spark, lambda c: T.ngrams(T.tokens(c), 3), ["a b c d", "a b", ""]) == [["a b c", "b c d"], [], []]
    assert [len(x) for x in run(spark, lambda c: T.chunks(T.words(c), 3, 2), [" ".join("abcdefgh"), "a", ""])] == [3, 0, 0]


def test_drop_reason(spark):
    long = " ".join(["word"] * 60)
    hindi = " ".join(["नमस्ते"] * 60)
    assert run(spark, T.drop_reason, ["few words", long, hindi, None]) == ["words=2 below floor (50)", "", "devanagari ratio above limit", "words=0 below floor (50)"]


def test_cruft(spark):
    assert run(spark, T.is_cruft, ["Categories: [download]", "Categories: [x](http://s/category/top-10)", "Categories: [history]"]) == [True, True, False]
