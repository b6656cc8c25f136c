"""Stages between operators: the gate, writers' bytes, cited distractors, flat payloads."""

import glob
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from lekha.functions import scores as C
from lekha.functions import shapes as X
from lekha.functions import special
from lekha.operators import evaluation, leakage
from lekha.sources import sinks
from lekha.streaming import stateful


def test_the_gate_stops_and_lets_pass(spark):
    hits = spark.createDataFrame([("q1", 3)], "qid string, doc_id long")
    with pytest.raises(leakage.LeakageError, match="q1"):
        leakage.gate(hits)
    assert leakage.gate(hits.limit(0)) is None


def test_sorted_parquet_has_the_same_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"t{i % 5}") for i in range(1000)], "k int, t string")
    prints = []
    for n, df in (("a", rows), ("b", rows.repartition(7))):
        sinks.parquet(df, str(tmp_path / n), order=["t", "k"], codec="snappy")
        prints.append([hashlib.sha256(open(f, "rb").read()).hexdigest() for f in sorted(glob.glob(str(tmp_path / n / "*.parquet")))])
    assert prints[0] == prints[1]


def cited(explanation, options, correct):
    """Brute force, as the definition reads."""
    t = explanation.lower()
    wrong = [(k, v) for k, v in options.items() if k in "ABCD" and k != correct.upper()]
    if not wrong or not t:
        return 0.0
    n = 0
    for k, v in wrong:
        k = k.lower()
        named = re.search(rf"(^|[^a-z0-9_])option\s+{k}([^a-z0-9_]|$)|\(\s*{k}\s*\)|(^|[^a-z0-9_]){k}\)", t)
        words = [w for w in re.findall("[a-zऀ-ॿ]+", v.lower()) if len(w) > 3 and w not in C.COMMON][:5]
        n += bool(named and any(w in t for w in words))
    return n / len(wrong)


def test_distractors_cited(spark):
    options = {"A": "Port tariff only", "B": "The river council and others", "C": "Harvest", "D": "None of these"}
    texts = ["Option B is wrong: the council met later.", "(a) names the tariff, c) the harvest", "", "B only", "option bold", "(d) none", "Options (a), (b) and (c): port, council, harvest", "नदी (b)"]
    df = spark.createDataFrame([(t, options, c) for t in texts for c in ("A", "d")], "t string, o map<string,string>, c string")
    got = [r.x for r in df.select(X.distractors_cited(F.col("t"), F.col("o"), F.col("c"), C.COMMON).alias("x")).collect()]
    assert got == pytest.approx([cited(t, options, c) for t in texts for c in ("A", "d")])
    assert max(got) > 0.6


def test_flat_payloads(spark):
    cases = [({"english": "E", "hindi": "H"}, "E"), ({"a": ["x", None, {"b": "y"}], "c": 3}, "x\ny\n3"), ([], ""), ("plain", "plain"), (None, ""), ({"english": "", "hindi": "H"}, "H")]
    df = spark.createDataFrame([(json.dumps(v),) for v, _ in cases] + [("{broken",), (None,)], "t string")
    assert [r.x for r in df.select(C.flat_json("t").alias("x")).collect()] == [w for _, w in cases] + ["{broken", None]


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (5, 0, 0.0625), (1, 1, 1.0), (8, 2, 0.109375), (10, 0, 0.001953)])
def test_exact_p_of_discordant_pairs(spark, b, c, p):
    rows = [("x", 1.0, 0.0)] * b + [("x", 0.0, 1.0)] * c + [("x", 1.0, 1.0)] * 3
    r = evaluation.discordant(spark.createDataFrame(rows, "g string, a double, b double"), ["g"]).first()
    assert (r.n, r.b, r.c) == (b + c + 3, b, c)
    assert r.p == pytest.approx(p, abs=1e-6)
    assert special.mcnemar(b, c) == pytest.approx(p, abs=1e-6)


def test_languages_of_one_question(spark):
    rows = [("C", f"q:{i}:{lang}", lang, int(right)) for i in range(10) for lang, right in (("en", i < 7), ("hi", 5 <= i < 9))] + [("C", "q:99:en", "en", 1)]
    r = evaluation.bilingual(spark.createDataFrame(rows, "condition string, question_id string, language string, is_correct int"), ["condition"]).first()
    assert (r.n, r.b, r.c) == (10, 5, 2) and r.acc_en == 0.7 and r.acc_hi == 0.4
    assert r.p == pytest.approx(special.mcnemar(5, 2))


def test_a_stream_cleans_as_a_batch(spark, tmp_path):
    rows = [(i, f"word {'word ' * (i * 3)}“end”  {i}\r\n") for i in range(40)] + [(99, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.append_shards(stateful.cleaned(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.doc_id, r.text, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.doc_id, r.text, r.reason) for r in stateful.cleaned(df).collect()}
