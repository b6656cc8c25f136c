"""Statistics against published and hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from lekha.functions import special
from lekha.operators import evaluation


def test_tails():
    assert special.mcnemar(8, 11) == pytest.approx(0.6476, abs=1e-4)
    assert special.mcnemar(25, 7) == pytest.approx(0.00210, abs=1e-5)
    assert special.binomial_upper(26, 50, 0.25) == pytest.approx(3.8e-5, rel=0.02)
    assert special.binomial_upper(15, 50, 0.25) == pytest.approx(0.252, abs=1e-3)
    assert special.t_two_sided(3.4159, 69) == pytest.approx(0.00107, abs=1e-5)
    assert special.chi2_upper(7.815, 3) == pytest.approx(0.05, abs=1e-4)


def test_calibration_error(spark):
    rows = [(0.0, 0), (0.05, 0), (1 / 15, 1), (0.5, 1), (0.52, 0), (1.0, 1), (None, 1)]
    bins = {}
    for c, y in rows[:-1]:
        k = max(0, math.ceil(round(c * 15, 9)) - 1)
        bins.setdefault(k, []).append((c, y))
    want = sum(len(v) / 6 * abs(sum(c for c, _ in v) / len(v) - sum(y for _, y in v) / len(v)) for v in bins.values())
    got = evaluation.calibration_error(spark.createDataFrame([("x", *r) for r in rows], "g string, c double, y int"), ["g"], "c", "y").first()
    assert got.ece == pytest.approx(want)
    assert got.n == 6


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04, None]
    m = len(p)
    order = sorted((1.0 if x is None else x) for x in p)
    q = {}
    for x in order:
        q[x] = min(1.0, min(y * m / max(i + 1 for i, z in enumerate(order) if z == y) for y in order if y >= x))
    got = evaluation.false_discovery(spark.createDataFrame([(x,) for x in p], "p double"), "p", "q").collect()
    assert all(r.q == pytest.approx(q[1.0 if r.p is None else r.p]) for r in got)


def average_ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def correlation(a, b):
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) if n else None


def test_kappa_and_ranks(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, 4.0), (2.5, 3.0)]
    df = spark.createDataFrame([("x", *r) for r in rows], "g string, a double, b double")
    a, b = [round(x) for x, _ in rows], [round(y) for _, y in rows]  # half to even
    seen = sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / 5
    chance = sum((x - y) ** 2 for x in a for y in b) / 25
    assert evaluation.weighted_kappa(df, ["g"], "a", "b").first().kappa == pytest.approx(1 - seen / chance)
    got = evaluation.rank_correlation(df, ["g"], "a", "b").first()
    x, y = [r[0] for r in rows], [r[1] for r in rows]
    assert got.pearson == pytest.approx(correlation(x, y))
    assert got.spearman == pytest.approx(correlation(average_ranks(x), average_ranks(y)))


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    long = spark.range(200).select(F.lit("c").alias("condition"), F.col("id").cast("string").alias("question_id"), (F.col("id") % 2).cast("double").alias("value"))
    a, b = (evaluation.bootstrap(long.repartition(n), ["condition"]).first() for n in (1, 5))
    assert a.mean == b.mean == 0.5
    assert 0.40 < a.ci_lo < 0.46 < 0.54 < a.ci_hi < 0.60
    assert (a.ci_lo, a.ci_hi) == (pytest.approx(b.ci_lo), pytest.approx(b.ci_hi))


def test_pairs_and_tests(spark):
    rows = [(c, "A", "en", f"q{i}", "is_correct", float((i * k) % 3 == 0)) for k, c in ((1, "C1"), (2, "C2"), (3, "C3")) for i in range(20)]
    long = spark.createDataFrame(rows, "condition string, task string, language string, question_id string, metric string, value double")
    p = evaluation.pairs(long, ["task"])
    assert p.count() == 60
    t = evaluation.paired_tests(p, ["task"]).collect()
    assert len(t) == 3
    assert all(0 <= r.t_p <= 1 for r in t if r.t_p is not None)
