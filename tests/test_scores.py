"""Scores against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lekha.functions import scores as C
from lekha.functions.stems import stem


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "n"), [
    ("It fell because rain failed; therefore prices rose.", 2), ("Firstly it rose, first of all.", 2), ("So that it held. As a result it grew.", 2), ("Ifs and buts", 0), ("becauseof", 0),
    # A mark at the end of a marker has its boundary at a letter only, as has the full stop of e.g.
    ("वह आया इसलिए मैं गया", 1), ("वह आया क्योंकि मैं गया", 0), ("लेकिन तब", 2), ("fruit, e.g. mangoes", 0), ("fruit, e.g.mangoes", 1), ("however, but", 2), ("but but but", 3),
])
def test_markers_of_reasoning(spark, text, n):
    got = one(spark, text, lambda t: C.markers_per_100(t) * C.n_tokens(t) / 100)
    assert got == pytest.approx(n)


def test_causal_markers_are_fewer(spark):
    text = "First it rose, but then it fell because of rain, although slowly."
    assert one(spark, text, lambda t: C.markers_per_100(t, C.CAUSAL) * C.n_tokens(t) / 100) == pytest.approx(2)
    assert one(spark, text, lambda t: C.markers_per_100(t) * C.n_tokens(t) / 100) == pytest.approx(5)


@pytest.mark.parametrize(("text", "want"), [
    ("I don't know.", True), ("I do  not know", False), ("I dont know", True), ("We cannot answer it", True), ("They cannot answering", False), ("none of the above", True), ("No answer", True), ("skipping this", True), ("skipped", False), ("SKIP", True),
    ("insufficient\ncontext", True), ("unable to determine the year", True), ("unable to decide", False), ("मुझे नहीं पता", True), ("मुझे पता नहीं है", True), ("उत्तर ज्ञात नहीं", True), ("जानकारी अनुपलब्ध", True), ("स्किप", True), ("असमर्थता", True), ("The answer is C.", False),
])
def test_abstentions(spark, text, want):
    assert one(spark, text, C.abstains) is want


@pytest.mark.parametrize(("text", "want"), [
    ("Critically comment on the act.", "high"), ("Analyze the reform.", "high"), ("List the rivers.", "low"), ("Outline the plan", "low"), ("Discuss and evaluate.", "high"), ("Justify the tax.", "unknown"), ("Account for the decline.", "unknown"), ("Listing rivers", "unknown"),
])
def test_directives(spark, text, want):
    assert one(spark, text, C.directive) == want


def test_schedule(spark):
    got = [r.x for r in spark.range(1000).orderBy("id").select(C.schedule(F.col("id"), 1000).alias("x")).collect()]
    assert got[0] == pytest.approx(0.1) and got[9] == 1.0 and got[10] == got[809] == 1.0
    assert got[905] == pytest.approx(0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * 95 / 190)))
    assert got[999] == pytest.approx(0.1, abs=1e-4)
    assert all(a >= b for a, b in zip(got[10:], got[11:], strict=False))


@pytest.mark.parametrize(("word", "want"), [
    # Examples of the published algorithm.
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("radicalli", "radic"), ("differentli", "differ"), ("vileli", "vile"), ("analogousli", "analog"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("callousness", "callous"), ("formaliti", "formal"), ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("defensible", "defens"), ("irritant", "irrit"), ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"), ("communism", "commun"), ("activate", "activ"), ("effective", "effect"), ("bowdlerize", "bowdler"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    # And of the extensions.
    ("dying", "die"), ("skies", "sky"), ("news", "news"), ("succeed", "succeed"), ("died", "die"), ("spied", "spi"), ("enjoy", "enjoy"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_overlap_of_stems(spark):
    df = spark.createDataFrame([("The ministers were reforming taxes", "The minister reformed the tax"), ("नदी", "नदी"), ("", "x"), (None, "x"), ("same words here", "same words here")], "c string, r string")
    got = [r.x for r in df.select(C.rouge_l("c", "r").alias("x")).collect()]
    # the, minist, reform and tax of five words each.
    assert got == pytest.approx([0.8, 0.0, 0.0, 0.0, 1.0])


@pytest.mark.parametrize(("text", "n", "share"), [("Article 14 and Article  21", [14, 21], 1.0), ("Article\n370, articles 3, Article 51A", [370, 51], 0.5), ("none", [], 1.0)])
def test_articles(spark, text, n, share):
    assert one(spark, text, C.articles) == n
    assert one(spark, text, lambda t: C.cited_share(t, tuple(range(1, 52)))) == share
