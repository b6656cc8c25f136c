"""Defects at any length, in any script, and copies given more than once."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lekha.llm import defects

ANSWER = "The harbour board lowered the tariff in 1954 because growers from the valley had asked for it. It also paid for two new roads, which the council had delayed for years."
ENDS = defects.TerminalContexts.fit([json.dumps({"answer": ANSWER}) for _ in range(30)] + [ANSWER] * 30)
REFUSAL = "I am sorry, but I cannot answer this question for you. "
OTHER = {
    "tamil": "தமிழ்நாடு இந்தியாவின் தென்பகுதியில் உள்ளது.",
    "urdu": "یہ سوال بہت مشکل ہے۔",
    "dutch": "De raad heeft het tarief verlaagd omdat de boeren uit het dal er om vroegen. Ook werden er twee nieuwe wegen aangelegd.",
    "four Hindi words": "परिषद ने कर घटाया।",
    "bengali": "নদী শান্ত ছিল।",
    "russian": "Совет снизил тариф.",
    "polish, by what is missing": "Rada obniżyła cło, ponieważ rolnicy z doliny prosili o to od lat, oraz zbudowała dwie nowe drogi. Rząd prowincji zapłacił za nie dopiero wtedy, gdy skończyła się wojna i wróciły zbiory.",
}


@pytest.mark.parametrize("times", [1, 5, 7, 40])
def test_refusals_of_any_length(times):
    assert defects.defect(REFUSAL * times, json.dumps({"question": "Who lowered the tariff?"}), "en", "B", ENDS) == "refusal"


def test_an_answer_that_once_says_it_is_unable_is_no_refusal():
    text = f"{ANSWER} I cannot give the exact sum. {ANSWER} {ANSWER}"
    assert defects.defect(text, json.dumps({"question": "Who lowered the tariff?"}), "en", "B", ENDS) is None


@pytest.mark.parametrize("name", OTHER)
def test_other_languages_in_any_script(name):
    assert defects.defect(OTHER[name], json.dumps({"question": "Who lowered the tariff?"}), "en", "B", ENDS) == "language"


def test_own_languages_are_no_defect():
    hindi = "जब आयोग ने ऋण को नियंत्रित किया, तब नगर की परिषद ने कर को स्थगित किया। वर्ष 1923 में मंत्रालय ने समिति और जिले को पुनर्गठित किया। घाटी की नदी शांत थी।"
    assert defects.defect(hindi, None, "hi", "B", ENDS) is None
    assert defects.defect("GDP", None, "hi", "B", ENDS) != "language"
    assert defects.defect(ANSWER, None, "hi", "B", ENDS) == "language"
    assert defects.defect(ANSWER, None, None, "B", ENDS) is None


@pytest.mark.parametrize("answer", ["Who is he?", "Who is he? Who is he?", "who is he", json.dumps({"score": 2, "strengths": ["Who is he?"], "improvements": ["Who is he?"]})])
def test_short_and_repeated_copies(answer):
    assert defects.defect(answer, json.dumps({"question": "Who is he?"}), "en", "B", ENDS) == "copy"


@pytest.mark.parametrize("times", [1, 2, 5])
def test_a_question_given_back_several_times_is_a_copy(times):
    question = "Which of the boards of the valley lowered the tariff of the harbour in 1954, and why?"
    assert defects.defect("\n".join([question] * times), json.dumps({"question": question}), "en", "B", ENDS) == "copy"
    assert defects.defect(f"{question} {ANSWER}", json.dumps({"question": question}), "en", "B", ENDS) is None


def test_broken_ends_are_fitted_to_every_answer(spark):
    n = 30_000
    # One answer in a thousand is long enough to be cut; the sample of before had 20,000.
    answer = F.when(F.col("id") % 1000 == 7, F.lit(ANSWER)).when(F.col("id") % 1000 == 8, None).otherwise(F.concat(F.lit("Port "), F.col("id"), F.lit(".")))
    answers = spark.range(n).select(answer.alias("answer"))
    got = defects.fit_ends(answers)
    assert sum(got.ends.values()) == n - n // 1000 and sum(got.cuts.values()) == pytest.approx(n // 1000, abs=0.01)
    want = defects.TerminalContexts.fit([r.answer for r in answers.collect()])
    again = defects.fit_ends(answers.repartition(7))
    assert (got.ends, got.cuts) == (want.ends, want.cuts) == (again.ends, again.cuts)


@pytest.mark.parametrize("text", [ANSWER, f'He said: "{ANSWER}" (so they say.)\n- Corn prices of the\n\n 2.  Port works, and roads\nthe end', "- a b c d e f\n- the\xa0toll of ten years * and, of. the\n(b) " + "of the old port " * 5 + "now", "परिषद ने कर को स्थगित किया।\n* घाटी की नदी शांत थी", "word" * 30])
def test_cuts_are_counted_at_every_place(text):
    want = Counter()
    for at in range(20, len(text)):
        cut = defects.Answer(None)
        cut.texts = [text[:at]]
        want[defects.context(cut)[1:]] += 1
    assert defects.cut_contexts(text) == want


def test_rare_contexts_are_seen_among_many_answers():
    short, stop, word = (defects.context(defects.Answer(t)) for t in ("this", ANSWER, ANSWER[:100]))
    ends = defects.TerminalContexts(Counter({stop: 300_000, short: 1}), Counter({word: 300_000, stop: 2_000, short: 19}))
    assert ends.broken(defects.Answer("this")) and not ends.broken(defects.Answer(ANSWER))
