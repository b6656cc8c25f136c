"""Running sums, budgets and packing."""

import random

from pyspark.sql import functions as F

from lekha.operators import ordered, sampling


def test_running_sum_over_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 9) if i % 7 else None) for i in range(500)]
    r.shuffle(rows)
    out = ordered.running_sum(spark.createDataFrame(rows, "id int, n int"), ["id"], "n", parts=7).orderBy("id").collect()
    total = 0
    for x in out:
        assert x.before == total
        total += x.n or 0


def test_pack_stream(spark):
    r = random.Random(2)
    docs = [(i, [r.randint(1, 99) for _ in range(r.choice([0, 1, 5, 30]))]) for i in range(60)] + [(99, None)]
    stream = []
    for _, ids in sorted(docs):
        if ids:
            stream += [*([] if ids[0] == -1 else [-1]), *ids, -2]
    rows = ordered.pack_stream(spark.createDataFrame(docs, "id int, ids array<int>"), ["id"], "ids", 16, eos=-2, bos=-1).orderBy("seq_no").collect()
    want = [stream[i : i + 16] for i in range(0, len(stream) - 15, 16)]
    assert [x.input_ids for x in rows] == want
    assert ordered.pack_stream(spark.createDataFrame([], "id int, ids array<int>"), ["id"], "ids", 16, eos=-2).count() == 0


def test_budget_stops_after_the_row_that_reaches_it(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else None, 10, 35) for i in range(20)], "id int, g string, n int, cap int").withColumn("o", sampling.order(1, F.col("id")))
    out = ordered.within_budget(df, "g", ["o", "id"], "n", "cap").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in out} == {"s": 4, None: 4}


def test_islands(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, True), ("b", 2, None)], "g string, o int, f boolean")
    assert {tuple(r) for r in ordered.islands(df, "g", "o", "f").collect()} == {("a", 1, 2, 2), ("a", 4, 4, 1), ("b", 1, 1, 1)}


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    parts = sampling.split(df, "g", "k", 0.1, 5)
    assert {r.g: r["count"] for r in parts.filter("part = 'valid'").groupBy("g").count().collect()} == {"0": 33, "1": 33, "2": 33}
    assert parts.count() == 1000
    assert sampling.stratified(df, ["g"], "k", 50, 5).count() == 50
    assert 400 < sampling.fraction(df, F.col("k"), 0.5).count() < 600
    assert sampling.repeat(df.limit(1).withColumn("t", F.lit(2.0)), "k", "t").count() == 2
    assert sampling.repeat(df.limit(5).withColumn("t", F.lit(0.0)), "k", "t").count() == 0
