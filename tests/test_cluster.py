"""What makes queries safe on a cluster: shipped code, a shared folder, no lost hits."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lekha import session
from lekha.operators import evaluation, leakage, ordered
from lekha.streaming import stateful


def test_no_temporary_checkpoints_on_a_cluster():
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_the_package_is_shipped_once(spark):
    session.ship(spark)
    assert [f for f in spark.sparkContext._python_includes if f.endswith("lekha.zip")] == ["lekha.zip"]


def test_probes_lose_no_hit(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    tests = [(f"q{i}", " ".join(r.choices(words, k=r.randint(20, 60)))) for i in range(20)]
    docs = []
    for i in range(120):
        body = r.choices(words, k=r.randint(0, 90))
        if i % 2:
            t = r.choice(tests)[1].split()
            n = r.randint(15, 30)
            at = r.randint(0, max(0, len(t) - n))
            body[r.randint(0, len(body)) : 0] = t[at : at + n]
        docs.append((i, " ".join(body)))
    docs += [(None, tests[0][1]), (500, None), (501, "")]
    grams = lambda t: {tuple((t or "").split()[k : k + 25]) for k in range(len((t or "").split()) - 24)}
    want = {(q, d) for q, t in tests for d, x in docs if grams(t) & grams(x)}
    evals = spark.createDataFrame(tests, "question_id string, q string").select("question_id", F.to_json(F.struct(F.col("q").alias("question"))).alias("gold_payload"))
    got = leakage.EvalIndex(evals).gram_hits(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    assert {(x.qid, x.doc_id) for x in got.collect()} == want
    assert len(want) > 10


def test_false_discovery_against_the_definition(spark):
    r = random.Random(4)
    p = [round(r.random() ** 3, 3) for _ in range(300)] + [None, 1.0, 0.0]
    got = {x.i: x.q for x in evaluation.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q").collect()}
    full = sorted((1.0 if v is None else v, i) for i, v in enumerate(p))
    least = 1.0
    for rank in range(len(full), 0, -1):
        v, i = full[rank - 1]
        least = min(least, v * len(full) / rank)
        assert got[i] == pytest.approx(least)


def test_later_min(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(200)]
    got = {x.i: x.m for x in ordered.later_min(spark.createDataFrame(rows, "i int, v double"), "i", "v", "m", parts=7).collect()}
    assert all(got[i] == min(v for j, v in rows if j >= i) for i, _ in rows)


def test_budget_of_a_stream_over_files(spark, tmp_path):
    rows = [(f"g{i % 2}" if i % 7 else "g0", i, 3 + i % 5) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], "g string, k int, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, k int, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        stateful.budgeted(stream, "g", ["k"], "n", 180, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want, used = set(), {}
    for g, k, n in rows:
        if used.get(g, 0) < 180:
            want.add((g, k))
            used[g] = used.get(g, 0) + n
    assert {(x.g, x.k) for x in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()} == want


def test_bootstrap_counts_equal_values(spark):
    rows = [("c", f"q{i}", 1.0 if i % 4 else 0.0) for i in range(400)] + [("d", "q", 2.0), ("e", "q", None)]
    got = {x.c: x for x in evaluation.bootstrap(spark.createDataFrame(rows, "c string, question_id string, value double"), ["c"]).collect()}
    assert got["c"].n == 400 and got["c"].mean == pytest.approx(0.75)
    assert got["c"].ci_lo == pytest.approx(0.75 - 1.96 * (0.75 * 0.25 / 400) ** 0.5, abs=0.012)
    assert got["d"].ci_lo == got["d"].ci_hi == 2.0 and "e" not in got
