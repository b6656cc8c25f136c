"""Readers, writers, HTML and streams on files."""

import json

from pyspark.sql import functions as F

from lekha.functions import html as H
from lekha.operators import leakage
from lekha.sources import sinks, trees
from lekha.streaming import stateful


def test_trees(spark, tmp_path):
    (tmp_path / "src_a/deep").mkdir(parents=True)
    (tmp_path / "src_b").mkdir()
    (tmp_path / "src_a/deep/one.md").write_text("first para\n\nsecond para")
    (tmp_path / "src_b/two.txt").write_text(f"r1\n{trees.DELIMITER}\nr2\n{trees.DELIMITER}\n  \n")
    (tmp_path / "src_b/rows.jsonl").write_text('{"text": "t1"}\nnot json\n{"prompt": "p", "completion": "c"}\n{"other": 1}\n')
    (tmp_path / "src_b/x.pdf").write_bytes(b"%PDF")
    docs = trees.documents(spark, str(tmp_path))
    assert {(r.rel_path, r.source, r.format) for r in docs.collect()} == {("src_a/deep/one.md", "src_a", "md"), ("src_b/two.txt", "src_b", "txt")}
    assert sorted(r.text for r in trees.records(docs).filter("source = 'src_b'").collect()) == ["r1", "r2"]
    assert trees.paragraphs(docs).filter("source = 'src_a'").count() == 2
    assert sorted(r.text for r in trees.json_lines(spark, str(tmp_path)).collect()) == ["p c", "t1"]

    def extract(content):
        raise ValueError(content)

    assert [(r.text, r.error) for r in trees.extracted(spark, str(tmp_path), extract).collect()] == [(None, "ValueError")]
    assert trees.overlay(docs, docs.limit(1)).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    sinks.parquet(df, str(tmp_path / "p"), order=["id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert sinks.fingerprint(df).first() == sinks.fingerprint(df.orderBy(F.desc("id"))).first()
    sinks.json_lines(df.select(sinks.chat(F.lit("q"), F.col("t")).alias("messages")), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["messages"][1]["content"] or "" for x in lines) == ["", "a"]


def test_html(spark):
    page = "<html><title>A &amp;  B</title><article>x</article><article><h2>Head</h2><script>a<b</script><p>One &lt; two</p><li>i</li></article><a href=\"/f.pdf\">f</a></html>"
    r = spark.createDataFrame([(page,), (None,)], "h string").select(H.title(F.col("h")).alias("t"), H.plain_text(H.container(F.col("h"))).alias("p"), H.markdown("h").alias("m"), H.links(F.col("h"), r"\.pdf").alias("l")).collect()
    assert r[0].t == "A & B"
    assert r[0].p.split("\n")[-1].strip() == "i"
    assert "## Head" in r[0].m
    assert r[0].l == ["/f.pdf"]
    assert r[1].t is None


def test_leakage(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    ev = spark.createDataFrame([("q1", json.dumps({"question": passage})), ("q2", json.dumps({"question": "कुछ हिन्दी शब्द"})), ("q3", None)], "question_id string, gold_payload string")
    index = leakage.EvalIndex(ev)
    corpus = spark.createDataFrame([(1, f"lead {passage} tail"), (2, " ".join(passage.split()[:20])), (3, passage.upper()), (4, None)], "id int, text string")
    assert {(r.qid, r.id) for r in index.gram_hits(corpus, "id").collect()} == {("q1", 1), ("q1", 3)}
    assert {r.id for r in index.hash_hits(corpus).collect()} == {3}
    assert {r.id for r in index.purge(corpus, ["id"]).collect()} == {2, 4}
    try:
        leakage.gate(index.gram_hits(corpus, "id"))
        raise AssertionError
    except leakage.LeakageError:
        pass


def test_streams(spark, tmp_path):
    rows = [("a", i, 10) for i in range(5)] + [("b", 1, 100)]
    spark.createDataFrame(rows, "g string, k bigint, n bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, k bigint, n bigint").parquet(str(tmp_path / "in"))
    q = stateful.append_shards(stateful.within_budget(stream, "g", "n", 25, ["g", "k", "n"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.g: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("g").count().collect()} == {"a": 3, "b": 1}
    assert stateful.latest(spark, str(tmp_path / "out"), ["g"], ["k"]).count() == 2
    gate = [("r", 0, 0.8), ("r", 1, 0.77), ("r", 2, 0.70)]
    spark.createDataFrame(gate, "run string, step bigint, acc double").write.parquet(str(tmp_path / "g"))
    s = spark.readStream.schema("run string, step bigint, acc double").parquet(str(tmp_path / "g"))
    q = stateful.append_shards(stateful.regression_gate(s, "run", "step", "acc"), str(tmp_path / "go"), str(tmp_path / "gc"))
    q.awaitTermination()
    assert {r.step: r.verdict for r in spark.read.parquet(str(tmp_path / "go")).collect()} == {0: "OK", 1: "WARN", 2: "HARD_STOP"}
